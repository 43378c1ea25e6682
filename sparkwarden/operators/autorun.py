"""What editors, agents, containers, build tools and CI start by themselves: commands in configuration, judged as shell text.

Configuration in JSON is read as its tools read it: escapes resolved, comments and trailing commas allowed, then as a
VARIANT. Commands stay arrays of a file's row; nothing is exploded, grouped or shuffled. A file with two equal keys in an
object counts as unreadable. Findings have the paths of programs that a command starts, where only these make it one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import host_of, let, line_of_match, line_of_text, strict_json, without_json_escapes, without_yaml_escapes
from sparkwarden.operators.shell import LOADS_CODE, dangerous_script, inline_code, literal_is_inert, programs, runs_checked_in, with_download, with_downloads

# Routes.
TASKS = r"(^|/)\.vscode/tasks\.json\z|\.code-workspace\z"
SETTINGS = r"(^|/)\.vscode/settings\.json\z|\.code-workspace\z"
DEVCONTAINER = r"(^|/)\.?devcontainer\.json\z"
MCP = r"(^|/)(\.mcp\.json|\.vscode/mcp\.json|\.cursor/mcp\.json|\.zed/settings\.json|\.gemini/settings\.json|\.roo/mcp\.json)\z"
HOOKS = r"(^|/)(\.claude/settings(\.local)?\.json|\.cursor/hooks\.json)\z"
ENVRC, PNPM, COMPOSER = r"(^|/)\.envrc\z", r"(^|/)\.pnpmfile\.cjs\z", r"(^|/)composer\.json\z"
MAKEFILE, DOCKERFILE, COMPOSE = r"(^|/)(Makefile|makefile|GNUmakefile)\z", r"(?i)(^|/)dockerfile\z|\.dockerfile\z", r"(^|/)(docker-)?compose\.ya?ml\z"
WORKFLOW = r"^\.github/workflows/[^/]+\.ya?ml\z"
# What the files must hold.
FOLDER_OPEN = r"[\"']runOn[\"']\s*:\s*[\"']folderOpen[\"']"
PRELOAD = r"""(?i)"(LD_PRELOAD|DYLD_INSERT_LIBRARIES|PYTHONSTARTUP)"\s*:\s*"[^"]+"|"NODE_OPTIONS"\s*:\s*"[^"]*--(?:require|import|loader|experimental-loader)[= ]+['"\\]*(?:\.{1,2}/[^"'\s\\]*|[^"'\s\\]*\.[cm]?[jt]s)\b"""
CONTAINER_HOOKS = ["postCreateCommand", "postStartCommand", "postAttachCommand", "onCreateCommand"]
OWN_SERVICE = r"\bnohup\s+(?:node|python3?|bash|sh)\s+[\"']?[\w./-]+\.(?:js|mjs|cjs|py|sh)[\"']?(?:\s+[\w./=-]+)*\s*(?:>{1,2}\s*[\w./-]+\s*)?(?:2>&1\s*)?&"
SERVER_TABLES = ["mcpServers", "servers", "context_servers"]
TOOL_PATH = r'"(eslint\.nodePath|eslint\.runtime|git\.path|terminal\.integrated\.automationProfile|deno\.path|python\.defaultInterpreterPath|php\.validate\.executablePath|go\.alternateTools|rust-analyzer\.server\.path|typescript\.tsdk|npm\.packageManager)"\s*:\s*"([^"]+)"'
INSTALLED_PATH = r"(^|/)(node_modules|\.yarn/sdks|\.venv|venv|\.tox)(/|\z)"
INSTALL_EVENT = r"^(pre-install-cmd|post-install-cmd|pre-update-cmd|post-update-cmd|post-autoload-dump|pre-autoload-dump)\z"
PHP_RUNS = r"(?i)@?php\s+-r|proc_open|shell_exec|\bsystem\s*\(|passthru|\beval\s*\(|base64_decode|(file_get_contents|fopen|copy)\s*\(\s*['\"]https?:"
SHELL_EVAL = r"\beval\s+\"?\$\{?\w+\}?\"?|\beval\s+\"\$\(\s*(?!curl|wget|base64)[\w.-]+(?:\s+[\w.=-]+){0,4}\s*\)\""
DECODED = r"(?m)base64\s+(-d|--decode)\b[^\n]{0,200}\|\s*(?:sudo\s+)?(?:sh|bash|zsh|dash|python3?|node|perl|ruby|source)\b|(?:^|[\s;&|`@-])(?:eval|sh\s+-c|bash\s+-c)\b[^\n]{0,1200}(?:\$\(|`)[^\n]*base64\s+(-d|--decode)|(?:^|[\s;&|`@-])eval\s[^\n]{0,1200}\$\("
LITERAL_PROGRAM = r"""\b(?:python3?\s+-c|node\s+-e)\s+(?:"(?:[^"\\\n]|\\.){0,2000}"|'(?:[^'\\\n]|\\.){0,2000}')"""
OBSCURE = r"base64\s+(-d|--decode)|\beval\b.*\$\(|python3?\s+-c|node\s+-e"
# A secret of a workflow in a curl command, hosts it commonly goes to, and words that name no service.
SECRET = r"(?i)\$\{\{\s*secrets\."
_REF = r"\$\{\{\s*secrets\.[^}\n]{0,200}\}\}"
_REST = r"[^\n]{0,1200}"
_HELD = rf"(\"[^\"\n]*{_REF}[^\"\n]*\"|'[^'\n]*{_REF}[^'\n]*'|[^\s\"']*{_REF}[^\s\"']*)"
SECRET_SENT = [rf"(?i)curl{_REST}\s(-d|--data(-binary|-raw|-urlencode|-ascii)?|-F|--form(-string)?|-T|--upload-file|--json)\s+{_HELD}", rf"(?i)curl{_REST}https?://[^\s\"'\n]*{_REF}", rf"(?i){_REF}{_REST}\|\s*curl"]
SECRET_SHOWN = rf"(?i)curl{_REST}\s(-H|--header|-u|--user)\s+{_HELD}"
SECRET_HOSTS = r"(?i)(^|\.)(github\.com|githubusercontent\.com|npmjs\.org|codecov\.io|coveralls\.io|slack\.com|vercel\.com|netlify\.com|sentry\.io|heroku\.com|cloudflare\.com|pypi\.org|docker\.io|ghcr\.io|render\.com|fly\.io|railway\.app|sonarcloud\.io|snyk\.io|hf\.co|huggingface\.co)\z"
BOT_TOKEN = r"(?i)api\.telegram\.org/bot\$\{\{\s*secrets\.[A-Z0-9_]+\s*\}\}/"
GENERIC = (
    "github githubusercontent gitlab amazonaws herokuapp workers vercel netlify pages deploy deployment token secret apikey auth prod production staging test dev admin user users data cloud host main service services "
    "server client access public private internal external release build config webhook hooks http https example local storage bucket registry npmjs docker"
).split()
ROUTES = [TASKS, SETTINGS, DEVCONTAINER, MCP, HOOKS, ENVRC, PNPM, COMPOSER, MAKEFILE, DOCKERFILE, COMPOSE, WORKFLOW]
_FINDING = "struct<id:string,severity:string,line:int,programs:array<string>>"


def _finding(id_: str, severity: Column | str, line: Column, paths: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(id_).alias("id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), line.cast("int").alias("line"), (none if paths is None else paths).alias("programs"))


def _texts(value: Column) -> Column:
    """The strings of an array in a VARIANT, none if it is no array; other elements are left out."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def _text(value: Column) -> Column:
    """A string in a VARIANT, null if it is anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _command_line(entry: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(_text(F.try_variant_get(entry, "$.command", "variant")), F.lit("")), F.array_join(_texts(F.try_variant_get(entry, "$.args", "variant")), " ")))


def _object(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def _entries(value: Column, path: str) -> Column:
    none = F.array().cast("array<struct<key:string,value:variant>>")
    return F.coalesce(F.map_entries(_object(value, path)), none)


def _task_commands(text: Column, parsed: Column) -> Column:
    tasks = F.coalesce(F.try_variant_get(parsed, "$.tasks", "array<variant>"), F.array().cast("array<variant>"))
    every = F.flatten(F.transform(tasks, lambda t: F.array(t, *(F.try_variant_get(t, f"$.{k}", "variant") for k in ("windows", "linux", "osx")))))
    lines = F.transform(F.filter(every, lambda t: t.isNotNull()), _command_line)
    args = F.transform(F.regexp_extract_all(text, F.lit(r"[\"']args[\"']\s*:\s*\[([^\]]{0,2000})\]"), F.lit(1)), lambda a: F.array_join(F.regexp_extract_all(a, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1)), " "))
    named = F.regexp_extract_all(text, F.lit(r"[\"']command[\"']\s*:\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.transform(F.filter(F.concat(lines, named, args), lambda c: c != ""), lambda c: F.struct(F.lit("").alias("name"), c.alias("command")))


def _server_commands(parsed: Column) -> Column:
    tables = F.concat(*(_entries(parsed, f"$.{k}") for k in SERVER_TABLES))
    served = F.filter(tables, lambda e: F.length(F.coalesce(_text(F.try_variant_get(e["value"], "$.command", "variant")), F.lit(""))) > 0)
    return F.transform(served, lambda e: F.struct(e["key"].alias("name"), _command_line(e["value"]).alias("command")))


def _hook_commands(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(r'"command"\s*:\s*"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    return F.transform(raw, lambda c: F.struct(c.alias("name"), F.regexp_replace(c, r'\\(["\\/])', "$1").alias("command")))


def _container_commands(parsed: Column) -> Column:
    def one(hook: str) -> Column:
        value = F.try_variant_get(parsed, f"$.{hook}", "variant")
        said = F.coalesce(_text(value), F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(_texts(value), " ")), F.to_json(value))
        return F.when(value.isNotNull(), F.struct(F.lit(hook).alias("name"), F.regexp_replace(said, OWN_SERVICE, "true").alias("command")))

    return F.array_compact(F.array(*(one(h) for h in CONTAINER_HOOKS)))


def _composer_commands(parsed: Column) -> Column:
    events = F.filter(_entries(parsed, "$.scripts"), lambda e: e["key"].rlike(INSTALL_EVENT))
    said = lambda v: F.coalesce(_text(v), F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(_texts(v), " ")), F.to_json(v))
    return F.transform(events, lambda e: F.struct(e["key"].alias("name"), said(e["value"]).alias("command")))


def _routed(files: DataFrame) -> DataFrame:
    path = F.col("path")
    route = F.lit(False)
    for r in ROUTES:
        route = route | path.rlike(r)
    return files.filter(route & F.col("content").isNotNull())


def _with_commands(files: DataFrame) -> DataFrame:
    """Routed files with `text` (escapes resolved), `parsed`, and the commands that their tool runs, as `cmds`."""
    path, content = F.col("path"), F.col("content")
    json = path.rlike(TASKS) | path.rlike(SETTINGS) | path.rlike(DEVCONTAINER) | path.rlike(MCP) | path.rlike(HOOKS) | path.rlike(COMPOSER)
    text = F.when(json, without_json_escapes(content)).when(path.rlike(WORKFLOW), without_yaml_escapes(content)).otherwise(content)
    rows = _routed(files).withColumn("text", text).withColumn("parsed", F.when(json, F.try_parse_json(strict_json(F.col("text")))))
    text, parsed = F.col("text"), F.col("parsed")
    none = F.array().cast("array<struct<name:string,command:string>>")
    cmds = (
        F.when(path.rlike(TASKS), F.when(text.rlike(FOLDER_OPEN), _task_commands(text, parsed)))
        .when(path.rlike(DEVCONTAINER), _container_commands(parsed))
        .when(path.rlike(MCP), _server_commands(parsed))
        .when(path.rlike(HOOKS), _hook_commands(text))
        .when(path.rlike(COMPOSER), _composer_commands(parsed))
    )
    rows = rows.withColumn("cmds", F.coalesce(cmds, none)).withColumn("_said", F.transform("cmds", lambda c: c["command"]))
    return with_downloads(rows, "_said", "_runs")


def _judged_commands() -> Column:
    """cmds with `loads` (plain pattern), `armed` (loads code, or downloads and runs) and `own` (starts a file of the repository)."""
    both = F.zip_with("cmds", "_runs", lambda c, r: F.struct(c["name"].alias("name"), c["command"].alias("command"), r.alias("runs")))
    return F.transform(both, lambda c: F.struct(c["name"].alias("name"), c["command"].alias("command"), (c["command"].rlike(LOADS_CODE) | c["runs"]).alias("loads"), dangerous_script(c["command"]).alias("dangerous"), c["runs"].alias("runs"), runs_checked_in(c["command"]).alias("own")))


def _first(items: Column, holds) -> Column:
    return F.get(F.filter(items, holds), F.lit(0))


def _started(id_: str, armed: Column, content: Column, text: Column, quote: bool, low: Column, low_line: Column) -> Column:
    """Of servers and hooks: high for what loads code, starts an own program or is preloaded, low if something is started at all."""
    preload = text.rlike(PRELOAD)
    needle = F.concat(F.lit('"'), armed["name"], F.lit('"')) if quote else armed["name"]
    line = F.coalesce(F.when(armed.isNotNull(), F.coalesce(line_of_text(content, needle), line_of_text(text, needle))), line_of_match(text, PRELOAD), F.lit(1))
    local = armed["own"] & ~armed["dangerous"]
    paths = F.when(local, programs(armed["command"])).otherwise(F.array().cast("array<string>"))
    return F.when(armed.isNotNull() | preload, _finding(id_, "high", line, F.coalesce(paths, F.array().cast("array<string>")))).when(low, _finding(id_, "low", low_line))


def _secret_sent(content: Column) -> Column:
    """Struct (severity, line) of a workflow's secret that goes to a host of no known kind."""
    joined = F.regexp_replace(content, r"(?<!\\)((?:\\\\)*+)\\\r?\n", "$1")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(SECRET) & ~x.rlike(r"^\s*#"))
    words = lambda x, sep: F.filter(F.split(F.lower(x), sep), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC))

    def trusted(x: Column) -> Column:
        host = host_of(F.regexp_replace(F.regexp_extract(x, r"(?i)https?://[^\s\"'`]+", 0), r"\$\{\{[^}]*(\}\}|\z)", "x"))
        name = F.regexp_extract(x, r"(?i)secrets\.([A-Z0-9_]+)", 1)
        return F.coalesce(host.rlike(SECRET_HOSTS) | F.arrays_overlap(words(name, r"[_\-.]"), words(host, r"[.-]")), F.lit(False))

    def sent(pattern: str) -> Column:
        hit = _first(lines, lambda x: x.rlike(pattern))
        fine = F.coalesce(let(hit, trusted) | hit.rlike(BOT_TOKEN), F.lit(False))
        return F.when(content.rlike(pattern) & ~fine, F.struct(F.lit("high").alias("severity"), line_of_match(content, pattern).alias("line")))

    shown = _first(lines, lambda x: x.rlike(SECRET_SHOWN) & ~trusted(x))
    medium = F.when(shown.isNotNull(), F.struct(F.lit("medium").alias("severity"), line_of_match(content, SECRET_SHOWN).alias("line")))
    return F.when(content.rlike(SECRET), F.coalesce(*(sent(p) for p in SECRET_SENT), medium))


def autorun_findings(files: DataFrame, own: Column | None = None) -> DataFrame:
    """files: repo_id, path, content. Rows (repo_id, id, severity, file, line, programs).

    own: addresses of the repository itself, lower case, as an array column; installers from there count as known.
    """
    rows = with_download(_with_commands(files), "text", own, "fetched").withColumn("judged", _judged_commands())
    path, content, text, parsed, judged, fetched = (F.col(c) for c in ("path", "content", "text", "parsed", "judged", "fetched"))
    at_fetch, object_ = fetched["line"], _object(parsed).isNotNull()
    armed = _first(judged, lambda c: c["dangerous"] | c["runs"] | c["own"])
    unread = _finding("unparseable-autorun-config", "medium", F.coalesce(line_of_match(content, r"\S"), F.lit(1)))
    task = F.exists(judged, lambda c: c["loads"] | c["own"])
    tool = _first(F.regexp_extract_all(text, F.lit(TOOL_PATH), F.lit(0)), lambda m: let(F.regexp_extract(m, TOOL_PATH, 2), lambda v: v.rlike(r"^(\./|\.\\|[^/\\:][\w./\\-]*/)") & ~v.rlike("^https?:") & ~v.rlike(INSTALLED_PATH)))
    envrc = F.regexp_replace(content, SHELL_EVAL, "")
    spawns = content.rlike("(?i)child_process") & content.rlike(r"(?i)https?://|base64|atob\(|/tmp/|\beval\b|node\s+-e")
    loader = content.rlike(LOADS_CODE) | fetched.isNotNull() | spawns | content.rlike(r"(?i)require\s*\(\s*[\"'`]https?:")
    obscure = content.rlike(DECODED) | F.exists(F.regexp_extract_all(content, F.lit(LITERAL_PROGRAM), F.lit(0)), lambda m: ~let(inline_code(m), literal_is_inert))
    secret = F.when(path.rlike(WORKFLOW), _secret_sent(text))
    first = F.filter(judged, lambda c: c["dangerous"] | c["runs"])
    singles = [
        F.when(path.rlike(TASKS) & text.rlike(FOLDER_OPEN), _finding("vscode-autorun-task", F.when(task, "high").otherwise("medium"), line_of_match(text, FOLDER_OPEN))),
        F.when(path.rlike(SETTINGS) & tool.isNotNull(), let(F.regexp_extract(tool, TOOL_PATH, 1), lambda k: _finding("vscode-tool-path-hijack", "high", F.coalesce(line_of_text(content, k), line_of_text(text, k))))),
        F.when(path.rlike(DEVCONTAINER) & ~object_, unread),
        F.when(path.rlike(DEVCONTAINER) & F.map_contains_key(_object(parsed), "initializeCommand"), _finding("devcontainer-initialize-command", "medium", line_of_text(content, F.lit("initializeCommand")))),
        F.when(path.rlike(MCP), F.when(~object_, unread).otherwise(_started("mcp-server-autostart", armed, content, text, True, F.size("cmds") > 0, line_of_match(text, r'"(mcpServers|servers|context_servers)"')))),
        F.when(path.rlike(HOOKS) & (text.contains('"hooks"') | text.rlike(PRELOAD)), _started("agent-hook-autorun", armed, content, text, False, F.size("cmds") > 0, line_of_text(text, F.lit('"hooks"')))),
        F.when(path.rlike(ENVRC), _finding("direnv-envrc", F.when(envrc.rlike(LOADS_CODE) | fetched.isNotNull(), "high").otherwise("low"), F.coalesce(line_of_match(content, "."), F.lit(1)))),
        F.when(path.rlike(PNPM), _finding("pnpm-install-hook", F.when(loader, "high").otherwise("medium"), F.coalesce(line_of_match(content, r"(?i)hooks|readPackage|module\.exports"), F.lit(1)))),
        F.when(path.rlike(MAKEFILE), F.when(fetched.isNotNull(), _finding("makefile-remote-exec", "high", at_fetch)).when(obscure, _finding("makefile-obfuscated-command", "medium", line_of_match(content, OBSCURE)))),
        F.when(path.rlike(DOCKERFILE) & fetched.isNotNull(), _finding("dockerfile-remote-exec", F.when(path.contains("/"), "medium").otherwise("high"), at_fetch)),
        F.when(path.rlike(COMPOSE) & fetched.isNotNull(), _finding("compose-remote-exec", "high", at_fetch)),
        F.when(path.rlike(WORKFLOW) & fetched.isNotNull(), _finding("workflow-remote-script", "low", at_fetch)),
        F.when(secret.isNotNull(), _finding("workflow-secret-exfiltration", secret["severity"], secret["line"])),
    ]
    none = F.array().cast(f"array<{_FINDING}>")
    container = F.when(path.rlike(DEVCONTAINER), F.transform(first, lambda c: _finding("devcontainer-dangerous-hook", "high", line_of_text(content, c["name"]))))
    composer = F.when(path.rlike(COMPOSER), F.transform(judged, lambda c: _finding("composer-install-script", F.when(c["command"].rlike(LOADS_CODE) | c["command"].rlike(PHP_RUNS), "high").otherwise("low"), line_of_text(content, F.concat(F.lit('"'), c["name"], F.lit('"'))))))
    every = F.concat(F.array_compact(F.array(*singles)), F.coalesce(container, none), F.coalesce(composer, none))
    return rows.select("repo_id", path.alias("file"), F.explode(every).alias("f")).select("repo_id", "f.id", "f.severity", "file", "f.line", "f.programs")


def autorun_references(files: DataFrame) -> DataFrame:
    """Rows (repo_id, from_path, rel): programs of the repository that editors, agents and containers start by themselves."""
    rows = _with_commands(files.filter(F.col("path").rlike(TASKS) | F.col("path").rlike(DEVCONTAINER) | F.col("path").rlike(MCP) | F.col("path").rlike(HOOKS)))
    every = F.array_distinct(F.flatten(F.transform("cmds", lambda c: programs(c["command"]))))
    return rows.select("repo_id", F.col("path").alias("from_path"), F.explode(every).alias("rel"))
