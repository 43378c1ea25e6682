"""Column helpers over paths, URLs and texts. All are built-in SQL functions; patterns over foreign text backtrack little."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used, within lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The part before the last slash, empty for a path at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset: line feeds strictly before it, and 1."""
    before = F.substring(content, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_of_match(content: Column, pattern: str) -> Column:
    """Line of the first match, null without one."""
    before = F.regexp_extract(content, rf"(?s)^(.*?)(?:{pattern})", 1)
    return F.when(content.rlike(pattern), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def place_of_match(content: Column, pattern: str) -> Column:
    """Place of the first match in characters, from 1; null without one."""
    return F.when(content.rlike(pattern), F.length(F.regexp_extract(content, rf"(?s)^(.*?)(?:{pattern})", 1)) + 1)


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, null where it isn't one."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, replacement or swap of neighbours turns a into b."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x, F.lit("")) != F.coalesce(y, F.lit(""))), True).cast("int")
    swapped = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, F.length(a)))
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (a != b) & (swapped == b))


def redacted(text: Column, most: int = 200) -> Column:
    """One line of text: controls and runs of white space as one space, long encoded runs cut short."""
    flat = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    flat = F.trim(F.regexp_replace(flat, r"\s+", " "))
    flat = F.regexp_replace(flat, r"([A-Za-z0-9+/=]{24})[A-Za-z0-9+/=]{24,}", "$1...")
    return F.substring(flat, F.lit(1), F.lit(most))


# Which marks begin a line that is only a comment, by the kind of file that the name implies.
COMMENTS = [
    (r"(?i)\.(js|mjs|cjs|jsx|ts|tsx|mts|cts|go|java|c|h|cc|cpp|cxx|hpp|cs|rs|swift|kt|kts|scala|php|dart|groovy|proto|sol)\z", r"///|//!|//|/\*|\*/|\*"),
    (r"(?i)\.(bat|cmd)\z", r"@?(?i:rem)|::"),
    (r"(?i)\.(sql|lua|hs|elm|adb|ads)\z", r"--"),
    (r"(?i)\.(html|htm|xml|xhtml|svg|vue|svelte|md|markdown)\z", r"<!--|-->"),
    (r"(?i)\.(sh|bash|zsh|ksh|py|rb|pl|pm|yml|yaml|toml|ini|cfg|conf|tf|tfvars|gradle|nix|ps1|psm1|psd1|dockerfile|mk)\z|(^|/)(Dockerfile|Makefile|GNUmakefile|Gemfile|Rakefile|Vagrantfile|Procfile|\.env[\w.-]*|\.gitignore|\.dockerignore)\z", r"#"),
]
OTHER_COMMENTS = r"//|#"


def code_text(path: Column, content: Column) -> Column:
    """content with the lines that hold only a comment blanked, so that a sentence about a deed is not taken for it."""
    out = blanked_comment_lines(content, OTHER_COMMENTS)
    for kind, marks in reversed(COMMENTS):
        # Most files have no such line, and are taken as they are.
        own = F.when(content.rlike(rf"(?md)^[^\S\n]*(?:{marks})(?:\s|$)"), blanked_comment_lines(content, marks)).otherwise(content)
        out = F.when(path.rlike(kind), own).otherwise(out)
    return out


def blanked_comment_lines(content: Column, marker: str) -> Column:
    """Lines that hold only a comment (its marker at the start, then white space or nothing) as blanks of the same length."""
    only = rf"^\s*(?:{marker})(?:\s|\z)"
    return F.array_join(F.transform(F.split(content, "\n"), lambda x: F.when(x.rlike(only), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n")


def outside_fences(content: Column) -> Column:
    """Lines of a markdown text that no code fence encloses; the fence lines are left out, too."""
    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fence = x.rlike(r"^\s*(```|~~~)")
        return F.struct(F.when(fence, ~a["inside"]).otherwise(a["inside"]).alias("inside"), F.when(fence | a["inside"], a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"))

    return F.array_join(F.aggregate(F.split(content, "\n"), zero, step, lambda a: a["kept"]), "\n")


# An escape of a JSON string that stands for a character which needs none; halves of a pair only together.
JSON_ESCAPE = r"(?:\\u(?!(?i:00[01][0-9a-f]|0022|005c|d[89a-f]))[0-9a-fA-F]{4}|\\u(?i:d[89ab][0-9a-f]{2})\\u(?i:d[c-f][0-9a-f]{2}))+"
YAML_ESCAPE = r"\\x(?!(?i:[01][0-9a-f]|22|5c))[0-9a-fA-F]{2}"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)'


def _unescaped(text: Column, pattern: str, pad: str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # Longer runs first: a shorter one may be part of them.
    found = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    char = lambda m: F.decode(F.unhex(F.concat(F.lit(pad), F.regexp_replace(m, r"\\[ux]", ""))), "UTF-16BE")
    return F.when(text.rlike(pattern), F.aggregate(found, text, lambda a, m: F.replace(a, m, char(m)))).otherwise(text)


def without_json_escapes(text: Column) -> Column:
    """text as a JSON reader sees its keys: escapes of plain characters resolved, those of quotes and controls kept."""
    return _unescaped(text, JSON_ESCAPE, "")


def without_yaml_escapes(text: Column) -> Column:
    """text with the escapes resolved that stand in double-quoted scalars of one line."""
    parts = F.regexp_extract_all(text, F.lit(r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|"|[^"]++'), F.lit(0))
    scalar = lambda x: F.when(x.rlike(r"^\".*\\[ux].*\"\z"), _unescaped(_unescaped(x, JSON_ESCAPE, ""), YAML_ESCAPE, "00")).otherwise(x)
    return F.when(text.rlike(r"\\[ux]"), F.array_join(F.transform(parts, scalar), "")).otherwise(text)


def strict_json(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON: one pass over strings and comments, one over commas."""
    bare = F.regexp_replace(text, rf"(?s)({_STRING})|//[^\n]*+|/\*.*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, rf"(?s)({_STRING})|,(?=\s*[}}\]])", "$1")


def line_of_text(content: Column, needle: Column) -> Column:
    """Line of the first place of a plain text, null without one."""
    at = F.instr(content, needle)
    return F.when(at > 0, line_of(content, at - 1))


def parsed_repository(text: Column) -> Column:
    """Struct (owner, repo) of a reference in short form, bare host or URL; null where it is none."""
    body = F.regexp_replace(F.trim(text), r"^(?i:https?://)?(?:(?i:www\.)?(?i:github\.com)/)?", "")
    owner = F.regexp_extract(body, r"^([A-Za-z0-9-]{1,39})/([\w.-]{1,100}?)(?:\.git)?/?(?:[?#].*)?$", 1)
    repo = F.regexp_extract(body, r"^([A-Za-z0-9-]{1,39})/([\w.-]{1,100}?)(?:\.git)?/?(?:[?#].*)?$", 2)
    return F.when((owner != "") & ~repo.rlike(r"^\.*$"), F.struct(owner.alias("owner"), repo.alias("repo")))
