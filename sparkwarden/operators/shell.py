"""What a shell text does: downloads that are run, scripts that load code, programs of the repository that it starts.

Commands are read in two steps. A fold over characters, one Arrow call per batch of texts, finds logical lines, quoted
command segments and which saved downloads are run further down; it gives a few structs per text. All that is judged then,
such as hosts, pipes, prompts and placeholders, is a Column over these structs, so no text is grouped or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from sparkwarden.functions.text import let, redacted

#: Characters of a logical line, and of one command in it.
LINE_CHARS, COMMAND_CHARS = 8_000, 4_000

# Hosts, some with a path, whose installers are commonly piped into a shell.
KNOWN_INSTALLERS = [
    "sh.rustup.rs", "foundry.paradigm.xyz", "get-ghcup.haskell.org", "rclone.org/install.sh", "dot.net/v1/dotnet-install.sh", "apt.llvm.org/llvm.sh", "release.anza.xyz", "release.solana.com", "get.pnpm.io", "get.docker.com",
    "deb.nodesource.com", "rpm.nodesource.com", "install.python-poetry.org", "astral.sh", "bun.sh", "bun.com", "get.wasmer.io", "fly.io/install.sh", "ollama.com/install.sh", "raw.githubusercontent.com/travis-ci/gimme/",
    "raw.githubusercontent.com/golangci/golangci-lint/", "golangci-lint.run/install.sh", "raw.githubusercontent.com/cargo-bins/cargo-binstall/", "deno.land/install.sh", "deno.land/x/install/", "get.helm.sh", "getcomposer.org",
    "install.goreleaser.com", "install-node.vercel.app", "bootstrap.pypa.io", "repo.anaconda.com", "repo.continuum.io", "raw.githubusercontent.com/nvm-sh/nvm/", "raw.githubusercontent.com/creationix/nvm/",
    "rustwasm.github.io/wasm-pack/installer/", "raw.githubusercontent.com/Homebrew/install/", "raw.githubusercontent.com/ohmyzsh/ohmyzsh/", "raw.githubusercontent.com/pyenv/pyenv-installer/", "pyenv.run", "get.rvm.io", "get.sdkman.io",
    "sdk.cloud.google.com", "nixos.org/nix/install", "install.determinate.systems", "yarnpkg.com/install.sh", "get.volta.sh", "fnm.vercel.app", "starship.rs/install.sh", "tailscale.com/install.sh", "get.acme.sh", "get.pulumi.com",
    "antigravity.google/cli/install.sh", "claude.ai/install.sh", "opencode.ai/install", "cursor.com/install", "mise.run", "raw.githubusercontent.com/trufflesecurity/trufflehog/", "raw.githubusercontent.com/anchore/syft/",
    "raw.githubusercontent.com/anchore/grype/", "raw.githubusercontent.com/aquasecurity/trivy/",
]
# The shapes of a download that is run, of texts that only show one, and of files that are read, not run.
URL = r"(?i)https?://[^\s'\"`|;)]+"
INTERPRETER = r"(sh|bash|zsh|ksh|dash|source|\.|node|python3?|perl|ruby|php)"
PIPED = r"(?i)\b(curl|wget)[^\S\n]+[^\s|][^\n]{0,200}?\|\s*(?:(?:sh|bash|zsh|ksh|dash)\b|(?:node|perl|ruby|php)\b(?!\s+-(?:c|e|r)\b)|python3?\b(?!\s+-(?:c|e|r|m)\b))"
AS_FILE = rf"(?i)(^|[\s;&|(]){INTERPRETER}\s+(-[a-zA-Z]+\s+)*<\(\s*(curl|wget)\b"
AS_TEXT = rf"(?i)(^|[\s;&|(])(eval|{INTERPRETER})\s+(-[a-zA-Z]+\s+)*[\"']?(\$\$?\(|`)\s*(curl|wget)\b"
PLACEHOLDER = r"\s<[\w -]{1,30}>"
SHOWN = [
    r"[\"'`]\s*\$\s*\z",
    r"[\"'`][^\"'`]*#[^\"'`]*\z",
    r"\b(echo|printf)\b[^\"'`]*[\"'`][^\"'`]*\z",
    r"(?:^|[;&|({]|\b(?:then|do|else)\b)\s*(warn|warning|info|error|err|die|fail|fatal|log|log_\w+|note|msg|say|print|puts|grep|egrep|rg)\b[^\"'`;&|]*[\"'`][^\"'`]*\z",
]
DATA_FILE = re.compile(r"\.(pem|crt|cer|json|ya?ml|toml|txt|csv|md|png|jpe?g|gif|svg|ico|zip|tar|gz|tgz|xz|bz2|zst|7z|pdf|html?|css|woff2?|ttf|db|sqlite|wasm)\Z", re.I)
SCRIPT_FILE = re.compile(r"\.(sh|bash|zsh|py|js|mjs|cjs|rb|pl|php|ps1)\Z", re.I)
COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|;)")
DIRECTIVE = re.compile(r"\s*//\s*go:generate|\s*#\s*shellcheck\s+shell=")
PRINTED = re.compile(r"(?:^|[\s;&|(])cat\s+(?:[12]?>&[12]\s+)?<<(-?)\s*(['\"]?)(\w+)\2\s*(?:[12]?>&[12])?\s*$")
VERIFIED = re.compile(r"\b(sha256sum|sha512sum|sha1sum|shasum|md5sum)\b[^\n]{0,80}(-c|--check)\b|\bopenssl\s+dgst\b|\bcertutil\b[^\n]{0,60}-hashfile|\b(sha256sum|sha512sum|shasum)\b[\s\S]{0,300}?(!=|-ne|==)\s*\"?\$\{?\w*(SHA|HASH|SUM|DIGEST)\w*", re.I)
DIGEST = re.compile(r"\b[0-9a-f]{40,128}\b", re.I)

_TOOL = re.compile(r"\b(?:curl|wget)\b", re.I)
_SEGMENT = re.compile(r"""(?:[^;|&"']++|&(?!&)|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+""")
_BY_INTERPRETER = re.compile(rf"(?:^|[\s;&|(]){INTERPRETER}\s+(?:-[a-zA-Z]+\s+)*[\"']?(?P<file>[^\s;&|)\"']+)", re.I)
_DIRECTLY = re.compile(r"(?:\./|chmod\s+[+a-z0-7]+\s+)(?P<file>[^\s;&|)]+)", re.I)
_ARGUMENT = r"(\"[^\"]*\"|'[^']*'|\S+)"
_CURL_OUT = re.compile(r"(?:^|\s)(?:-[a-zA-Z]*o|--output(?:-document)?)(?:=|\s+)" + _ARGUMENT)
_CURL_NAMED = re.compile(r"(?:^|\s)(?:-[a-zA-Z]*O\b|--remote-name)")
_WGET_OUT = re.compile(r"(?:^|\s)(?:-[a-zA-Z]*O|--output-document)(?:=|\s+)?" + _ARGUMENT)
_ADDRESS = re.compile(r"https?://[^\s'\"`|;)]+", re.I)
_LINES = pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string()), ("saved", pa.list_(pa.string()))]))


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """(number, text) of each line, with the lines that an odd number of backslashes at the end joins to it; comment lines are empty."""
    number, parts, held = 0, [], 0
    for at, raw in enumerate(text.split("\n"), 1):
        raw = raw.removesuffix("\r")
        joined = (len(raw) - len(raw.rstrip("\\"))) % 2
        own = "" if raw.lstrip().startswith("#") else raw[:-1] if joined else raw
        number = number or at
        if held < LINE_CHARS:
            parts.append(own)
            held += len(own)
        if not joined:
            yield number, "".join(parts)
            number, parts, held = 0, [], 0
    if number:
        yield number, "".join(parts)


def _printed_lines(text: str) -> set[int]:
    """Numbers of the lines of here-documents that a bare cat shows."""
    shown, end, strip = set(), None, False
    if "<<" not in text:
        return shown
    for at, raw in enumerate(text.split("\n"), 1):
        body = raw.removesuffix("\r")
        if end is not None:
            if (body.lstrip("\t") if strip else body) == end:
                end = None
            else:
                shown.add(at)
        elif "<<" in body and (m := PRINTED.search(body)):
            strip, end = m[1] == "-", m[3]
    return shown


def _base(path: str) -> str:
    return re.split(r"[\\/]", path.strip("\"'"))[-1]


def saved_file(command: str) -> str | None:
    """The file that a download command writes, None if it writes to its output."""
    address = _ADDRESS.search(command)
    remote = re.split(r"[?#]", address[0])[0].rpartition("/")[2] if address else ""
    if command[:4].lower() == "curl":
        m = _CURL_OUT.search(command)
        name = m[1].strip("\"'") if m else remote if _CURL_NAMED.search(command) else ""
    else:
        m = _WGET_OUT.search(command)
        name = m[1].strip("\"'") if m else remote
    return None if name in ("", "-") or name.startswith("/dev/") else name


def _read(text: str) -> list[dict]:
    """Logical lines that may download and run: those with a pipe or a substitution, and saved downloads that are run later."""
    lines, total = [], 0
    for number, line in logical_lines(text):
        lines.append((number, total, line))
        total += len(line) + 1
    printed = _printed_lines(text)
    last: dict[tuple[str, bool], int] = {}
    for _, start, line in lines:
        for direct, pattern in ((False, _BY_INTERPRETER), (True, _DIRECTLY)):
            for m in pattern.finditer(line):
                last[_base(m["file"]).lower(), direct] = start + m.start()
    whole = "\n".join(line for _, _, line in lines)
    verified = max((m.start() for m in VERIFIED.finditer(whole)), default=-1) if DIGEST.search(text) else -1
    out = []
    for number, start, line in lines:
        if number in printed or not _TOOL.search(line) or (COMMENT.match(line) and not DIRECTIVE.match(line)):
            continue
        saved, done = [], 0
        for m in _TOOL.finditer(line):
            if m.start() < done:
                continue
            command = _SEGMENT.match(line, m.start(), m.start() + COMMAND_CHARS)[0]
            done = m.start() + len(command)
            name = saved_file(command)
            if not name or DATA_FILE.search(name):
                continue
            key, at = _base(name).lower(), start + m.start()
            runs = last.get((key, False), -1) >= at or (SCRIPT_FILE.search(name) and last.get((key, True), -1) >= at)
            if key and runs and verified < at:
                saved.append(command)
        if saved or "|" in line or "<(" in line or "$(" in line or "`" in line:
            out.append({"line": number, "text": line, "saved": saved})
    return out


@arrow_udf(ArrayType(StructType().add("line", IntegerType()).add("text", StringType()).add("saved", ArrayType(StringType()))))
def _commands(texts: pa.Array) -> pa.Array:
    return pa.array([_read(t) if t is not None else None for t in texts.to_pylist()], _LINES)


def _installer() -> str:
    """One pattern of the addresses of known installers; a name before @ is not the host."""
    hosts = []
    for entry in KNOWN_INSTALLERS:
        host, slash, path = entry.partition("/")
        end = re.escape(slash + path) if slash else r"(?=[/?#]|\z)"
        hosts.append(f"(?i:{re.escape(host)})(?::\\d+)?{end}")
    return r"^(?i:https?)://(?:[^/?#@]*@)?(?:" + "|".join(hosts) + ")"


INSTALLER = _installer()


def known_installers(command: Column, own: Column | None = None) -> Column:
    """Whether a command has addresses and all are of known installers, or begin with one of own (lower-case prefixes)."""
    urls = F.regexp_extract_all(command, F.lit(URL), F.lit(0))
    known = lambda u: u.rlike(INSTALLER)
    if own is not None:
        known = lambda u: u.rlike(INSTALLER) | F.exists(own, lambda p: F.lower(u).startswith(p))
    return (F.size(urls) > 0) & F.forall(urls, known)


def _before(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, rf"(?s)^(.*?)(?:{pattern})", 1)


def _only_shown(before: Column) -> Column:
    return before.rlike(SHOWN[0]) | before.rlike(SHOWN[1]) | before.rlike(SHOWN[2]) | before.rlike(SHOWN[3])


def _located(x: Column, before: Column, command: Column) -> Column:
    start = F.greatest(F.lit(0), F.length(before) - 40)
    around = F.substring(x["text"], start + 1, F.length(before) - start + F.least(F.length(command) + 140, F.lit(300)))
    return F.struct(x["line"].alias("line"), redacted(around).alias("snippet"), command.alias("command"))


def _judged(x: Column, own: Column | None) -> Column:
    """The download that a line runs, null if none."""
    text = x["text"]
    placeholder = lambda c: c.rlike(PLACEHOLDER) & ~c.rlike("(?i)https?://")
    rest_of = r"""(?is)^((?:[^;|&"']++|&(?!&)|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+)"""

    def piped(m: Column) -> Column:
        last = F.regexp_extract(m["found"], r"(?is)^.*(\b(?:curl|wget)\b.*)$", 1)
        return F.when(~placeholder(last) & ~_only_shown(m["before"]) & ~known_installers(last, own), _located(x, m["before"], m["found"]))

    def handed(m: Column) -> Column:
        rest = F.regexp_extract(F.substring(text, F.length(m["before"]) + F.length(m["found"]) - 3, F.lit(COMMAND_CHARS)), rest_of, 1)
        return F.when(~_only_shown(m["before"]) & ~known_installers(rest, own), _located(x, m["before"], m["found"]))

    def saved(command: Column) -> Column:
        return F.when(command.isNotNull(), _located(x, F.call_function("substring_index", text, command, F.lit(1)), command))

    tries = []
    for pattern, then in ((PIPED, piped), (AS_FILE, handed), (AS_TEXT, handed)):
        match = F.struct(F.regexp_extract(text, pattern, 0).alias("found"), _before(text, pattern).alias("before"))
        tries.append(F.when(text.rlike(pattern), let(match, then)))
    tries.append(let(F.get(F.filter(x["saved"], lambda c: ~known_installers(c, own) & ~placeholder(c)), F.lit(0)), saved))
    return F.coalesce(*tries)


def with_download(texts: DataFrame, column: str, own: Column | None = None, name: str = "download") -> DataFrame:
    """texts with the first download that a text runs, as a struct (line, snippet, command), else null.

    Pipes into an interpreter, process and command substitutions, and files saved and run later count, unless all
    addresses are of known installers or of own, the text only shows the command, or a committed digest is checked first.
    """
    asked = F.when(F.col(column).rlike("(?i)curl|wget"), F.col(column))
    found = texts.withColumn("_lines", _commands(asked))
    hits = F.filter(F.transform("_lines", lambda x: _judged(x, own)), lambda x: x.isNotNull())
    return found.withColumn(name, F.get(hits, F.lit(0))).drop("_lines")


@arrow_udf(ArrayType(ArrayType(StructType().add("line", IntegerType()).add("text", StringType()).add("saved", ArrayType(StringType())))))
def _commands_of(texts: pa.Array) -> pa.Array:
    return pa.array([[_read(t) if t is not None and _TOOL.search(t) else [] for t in ts] if ts is not None else None for ts in texts.to_pylist()], pa.list_(_LINES))


def with_downloads(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with, for each text of an array, whether it downloads and runs, judged each by itself."""
    asked = F.when(F.exists(column, lambda t: t.rlike("(?i)curl|wget")), F.col(column))
    found = rows.withColumn("_lines", _commands_of(asked))
    hits = F.transform("_lines", lambda ls: F.exists(ls, lambda x: _judged(x, None).isNotNull()))
    return found.withColumn(name, F.coalesce(hits, F.transform(column, lambda t: F.lit(False)))).drop("_lines")


# Scripts that load code, and harmless idioms that are taken out of a script before it is judged.
LOADS_CODE = r"""(?i)(curl|wget)\s+[^\s|][^\n]{0,120}\|\s*(sh|bash|node|python)|(^|[\s;&])(node\s+-e|python3?\s+-c)\b|\beval\b|base64\s+(-d|--decode)|atob\(|(https?://(?!localhost[:/\s"']|127\.0\.0\.1|0\.0\.0\.0|\[::1\])[^\n]{1,300}?(?:\|\|?|&&|;|["'])\s*(?:sudo\s+)?(node|npx|sh|bash|python3?)\b)|(^|[\s;&|(])(node|sh|bash|python3?)\s+(?:-\S{1,60}\s+)*https?://(?!localhost[:/\s"']|127\.0\.0\.1|0\.0\.0\.0|\[::1\])|(start\s+/b\s+node)|(nohup\s+(node|bash|sh|python)[^\n]{0,80}&)|\b(npx|tsx)\s+https?://|powershell[^\n]{0,80}(-enc|downloadstring|iwr|invoke-webrequest)|(sh|bash|zsh|source|\.)\s+(-[a-zA-Z]+\s+)*<\(\s*(curl|wget)\b|(sh|bash|zsh)\s+(-[a-zA-Z]+\s+)*["']?(\$\(|`)\s*(curl|wget)\b"""
INLINE = r"""\b(?:node\s+-e|python3?\s+-c)\s+(?:"(?:[^"\\]|\\.){0,2000}"|'(?:[^'\\]|\\.){0,2000}')"""
INLINE_DANGER = r"(?i)\b(fetch|https?|net|dgram|tls|socket|urllib\d?|requests|httpx|aiohttp|child_process|spawn\w*|exec\w*|popen|subprocess|system|eval|Function|compile|__import__|importlib|base64|b64decode|atob|btoa|Buffer|fromCharCode|codecs|marshal|pickle|ctypes|dlopen|vm|worker_threads|shutil|process\.binding)\b|\\x[0-9a-f]{2}|\\u\{?[0-9a-f]{4}|\\[0-7]{3}"
INERT_MODULE = r"^(?:node:)?(?:fs|path|os\.path|json|sys|re|datetime|time|math|random|string|collections|itertools|functools|textwrap|pathlib|typing|enum|dataclasses|uuid|hashlib)\z|^\.{1,2}/"
LEAVES_PROJECT = r"['\"`](/|~)|\.\.|homedir|expanduser|\.home\s*\(|getenv|tmpdir|gettempdir|process\.env\.(HOME|USERPROFILE|APPDATA|TMP)|environ"
INSTALLER_PIPE = r"\b(?:curl|wget)\b[^|;&\n]{0,300}\|\s*(?:ba|z|da)?sh\b"
TOOL_EVAL = r"\beval\s+\\?\"\\?\$\(\s*(?!curl|wget|base64)[\w.-]+(?:\s+[\w.=-]+){0,4}\s*\)\\?\""
ONLY_PRINTS = r"console\.(?:log|error|warn|info)\(\s*(?:'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|`(?:[^`\\$]|\\.)*+`)\s*\)"
_CHILD = r"require\(\s*['\"](?:node:)?child_process['\"]\s*\)"
OWN_SCRIPT = _CHILD + r"\s*\.(?:execSync|execFileSync|spawnSync)\(\s*['\"](?:node|sh|bash|python3?)\s+\.{0,2}/?[\w./-]+\.(?:js|cjs|mjs|sh|py)(?:\s+[\w./=-]+)*['\"][^)]{0,120}\)"
OWN_FILES = r"require\(\s*['\"](?:node:)?fs['\"]\s*\)\s*\.(?:existsSync|statSync|mkdirSync|rmSync|rmdirSync|unlinkSync)\(\s*['\"](?![^'\"]*\.\.)\.?/?[\w./-]+['\"]\s*(?:,\s*\{[^{}]{0,160}\}\s*)?\)"
INSTALLED_TOOL = _CHILD + r"\s*\.execSync\(\s*['\"](?:husky(?:\s+install)?|(?:npx|bunx|pnpm\s+exec|yarn)\s+(?!(?:curl|wget|sh|bash|zsh|node|python3?|deno|bun|ruby|perl|powershell|pwsh|cmd|eval|sudo)\b)[\w@][\w@/.-]*(?:\s+[\w@/.:=-]+)*)['\"][^)]*\)"
GIT_CALL = r"\b(?:cp|" + _CHILD + r")\s*\.\s*(?:execSync|execFileSync|spawnSync)\(\s*(['\"])git\s[^'\"]{1,120}\1\s*(?:,\s*\{[^{}]{0,120}\}\s*)?\)"
CHILD_BOUND = r"(?:(?:const|let|var)\s+)?\bcp\s*=\s*" + _CHILD + r"\s*,?"
RUNS_CHECKED_IN = r"(^|\s)(node|sh|bash|zsh|python3?|perl|ruby|php)\s+(-\S{1,60}\s+)*\.?\.?[\w./\\-]*\.(js|mjs|cjs|sh|py|rb|pl|php)\b|(^|[;&|]\s*|\n\s*)\./\S+"
INSTALLED = r"(^|\s|/)node_modules/"
PROGRAM_FILE, PROGRAM_PATH = r"(\.?/?[\w./-]+\.(?:js|cjs|mjs|ts|py|sh|rb|pl|php))\b", r"(?:^|\s)(\./[\w.-]+(?:/[\w.-]+)*)"


def _replaced_where(text: Column, pattern: str, holds, by: str) -> Column:
    """text with the matches for which holds(match) is true replaced."""

    def replaced(t: Column) -> Column:
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.aggregate(F.filter(matches, holds), t, lambda a, m: F.replace(a, m, F.lit(by)))

    # text is an expression of its own, often a long one: it is worked out once.
    return let(text, replaced)


def inline_code(call: Column) -> Column:
    """The program in an inline call of an interpreter."""
    return F.regexp_replace(call, r"^\w+\s+-[ec]\s+[\"']|[\"']\z", "")


def literal_is_inert(code: Column) -> Column:
    return ~code.rlike(INLINE_DANGER) & ~code.rlike(LEAVES_PROJECT)


def inline_is_inert(code: Column) -> Column:
    """Whether an inline program only computes and touches files of the project."""
    modules = F.concat(
        F.regexp_extract_all(code, F.lit(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), F.lit(1)),
        F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"(?:^|[;\s])import\s+([\w.]+(?:\s*,\s*[\w.]+)*)"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*"))),
        F.regexp_extract_all(code, F.lit(r"(?:^|[;\s])from\s+([\w.]+)\s+import\b"), F.lit(1)),
    )
    return F.forall(modules, lambda m: m.rlike(INERT_MODULE)) & ~code.rlike(r"\brequire\s*\(\s*[^'\"\s]") & literal_is_inert(code)


def dangerous_script(command: Column) -> Column:
    """Whether a script loads code, after what only looks like it has been taken out."""
    text = F.regexp_replace(command, TOOL_EVAL, "true")
    text = _replaced_where(text, INSTALLER_PIPE, lambda m: known_installers(m), "true")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ONLY_PRINTS, "0"), OWN_SCRIPT, "true"), OWN_FILES, "true")

    def inert(call: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(F.regexp_replace(inline_code(call), INSTALLED_TOOL, "true"), GIT_CALL, "0"), CHILD_BOUND, "")
        return let(code, inline_is_inert)

    return _replaced_where(text, INLINE, inert, "true").rlike(LOADS_CODE)


def runs_checked_in(command: Column) -> Column:
    """Whether a command starts a file of the repository rather than an installed program."""
    return command.rlike(RUNS_CHECKED_IN) & ~command.rlike(INSTALLED)


def programs(command: Column) -> Column:
    """Paths of the repository that a command starts, without ./ and without those that leave it."""
    found = F.concat(F.regexp_extract_all(command, F.lit(PROGRAM_FILE), F.lit(1)), F.regexp_extract_all(command, F.lit(PROGRAM_PATH), F.lit(1)))
    bare = F.transform(found, lambda p: F.regexp_replace(p, r"^\./", ""))
    return F.array_distinct(F.filter(bare, lambda p: (p != "") & ~p.startswith("/") & ~p.contains("..")))
