"""What a file hides from its reader: characters that show nothing or reorder a line, mixed alphabets, packed literals.

A cheap pattern decides which files have anything to look at. Of these a fold, one Arrow call per batch, finds places that
depend on what stands around them, and string literals; severities, lines and entropies are Columns over what it gives.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from sparkwarden.functions.text import code_text, let, line_of
from sparkwarden.operators.selection import PATTERNS
from sparkwarden.operators.signatures import read_as_code

# Characters without a width, controls of direction, scripts that are written from right to left, alphabets
# with letters that look like Latin ones, and the least length and entropy of a packed literal.
NO_WIDTH, DIRECTION = "​‌‍⁠­﻿", "‪-‮⁦-⁩"
CONTROLS = re.compile("[​-‏‪-‮⁠-⁩﻿]")
RIGHT_TO_LEFT = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]")
MIXED = "[A-Za-z][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][A-Za-z]"
URL_MIXED = "https?://[^\\s\"'`<>]{0,200}[\u0080-￿][^\\s\"'`<>]{0,200}"
PACKED, BITS = 120, 5.0
LITERAL = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\[^\n])*+){q}") for q in "\"'`"}
CLOSE, NEAR_CONTROLS, NEAR_SCRIPT, NEAR_TEXT, PADDING = 30, 12, 24, 8, 3

_quote, _no_width, _direction, _mixed, _code_mark = re.compile("[\"'`]"), re.compile(f"[{NO_WIDTH}]"), re.compile(f"[{DIRECTION}]"), re.compile(MIXED), re.compile(r"[=(){};[\]<>]")
_FOUND = StructType().add("unseen", IntegerType()).add("turned", IntegerType()).add("turned_comment", IntegerType()).add("mixed", IntegerType()).add("packed", ArrayType(StructType().add("at", IntegerType()).add("run", StringType())))
_ARROW = pa.struct([(n, pa.int32()) for n in ("unseen", "turned", "turned_comment", "mixed")] + [("packed", pa.list_(pa.struct([("at", pa.int32()), ("run", pa.string())])))])


def literals(text: str) -> list[tuple[int, str]]:
    """(place, value) of the quoted strings of 40 to 4,000 characters that close on their line. A kind of quote that does not close is not tried again on its line."""
    out, start = [], 0
    for line in text.split("\n"):
        at, open_ = 0, set()
        while m := _quote.search(line, at):
            at = m.start()
            found = None if m[0] in open_ else LITERAL[m[0]].match(line, at)
            if found:
                if 40 <= len(found[1]) <= 4000:
                    out.append((start + at, found[1]))
                at = found.end()
            else:
                open_.add(m[0])
                at += 1
        start += len(line) + 1
    return out


def unseen(text: str, code: str) -> int | None:
    """The first character without a width that splits a word of code; those that lay out text, pad it or join files are passed over."""
    places = [m.start() for m in _no_width.finditer(text)]
    word = lambda c: c.isascii() and (c.isalnum() or c in "_$")
    for i in places:
        c, before, after = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        if (i == 0 and c == "﻿") or code[i : i + 1] != c or bisect_right(places, i + CLOSE) - bisect_left(places, i - CLOSE) >= PADDING:
            continue
        around = text[max(0, i - NEAR_TEXT) : i + NEAR_TEXT + 1].replace(c, "", 1)
        if not around.isascii() or before in ("", "\n", '"', "'", "`") or (after and after in "\"'`"):
            continue
        letter = before.isascii() and before.isalpha()
        if letter and (c == "­" or (after and after in ".,!?" and (text[i + 2 : i + 3] or " ") in " \t\r\n\v\f<")):
            continue
        sides = [bool(x) and word(x) for x in (before, after)]
        if all(sides) if c in "‌‍" else any(sides):
            return i
    return None


def turned(text: str, code: str) -> tuple[int | None, int | None]:
    """The first control of direction on a line with code, and the first in a comment before it; lists of controls and right-to-left text aside."""
    comment = None
    for m in _direction.finditer(text):
        i = m.start()
        alone = text[i - 1 : i] in ('"', "'", "`") and text[i + 1 : i + 2] == text[i - 1 : i] if i else False
        listed = len(set(CONTROLS.findall(text[max(0, i - NEAR_CONTROLS) : i + NEAR_CONTROLS]))) >= PADDING
        if alone or listed or RIGHT_TO_LEFT.search(text[max(0, i - NEAR_SCRIPT) : i + NEAR_SCRIPT + 1]):
            continue
        if code[i : i + 1] == text[i]:
            return i, comment
        comment = i if comment is None else comment
    return None, comment


def mixed(text: str, known: list[tuple[int, str]]) -> int | None:
    """The first word of two alphabets outside prose: literals with a blank, and lines of six words without marks of code."""
    prose = [(a, a + len(v) + 2) for a, v in known if " " in v]
    starts = [a for a, _ in prose]
    passed = -1  # the end of a line that is prose
    for m in _mixed.finditer(text):
        i = m.start()
        k = bisect_right(starts, i) - 1
        if i < passed or (k >= 0 and i < prose[k][1]):
            continue
        end = text.find("\n", i)
        end = end if end >= 0 else len(text)
        line = text[text.rfind("\n", 0, i) + 1 : end]
        if len(line.split()) < 6 or _code_mark.search(line):
            return i
        passed = end
    return None


@arrow_udf(_FOUND)
def _places(texts: pa.Array, codes: pa.Array) -> pa.Array:
    out = []
    for text, code in zip(texts.to_pylist(), codes.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        known = literals(text)
        runs = [(a, max(v.split(), key=len, default="")) for a, v in known if len(v) >= PACKED]
        at, comment = turned(text, code)
        out.append({"unseen": unseen(text, code), "turned": at, "turned_comment": comment, "mixed": mixed(text, known), "packed": [{"at": a, "run": r} for a, r in runs if len(r) >= PACKED]})
    return pa.array(out, _ARROW)


def entropy_of(text: Column) -> Column:
    """Bits per character of a text. A character is counted by what is left without it, one built-in call for each distinct one."""
    chars, n = F.filter(F.split(text, ""), lambda c: c != ""), F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))


def hidden_findings(files: DataFrame) -> DataFrame:
    """files: repo_id, path, content. Rows (repo_id, id, severity, file, line) of code and of instruction files."""
    path, content, p = F.col("path"), F.col("content"), F.col("places")
    idle = F.col("executable") if "executable" in files.columns else F.lit(False)
    routed = files.filter(read_as_code(path, idle) | path.rlike(PATTERNS["instructions"]))
    some = content.rlike(f"[{NO_WIDTH}{DIRECTION}]|{MIXED}|[\"'`][^\\n]{{{PACKED},}}")
    rows = routed.filter(some).withColumn("code", code_text(path, content))
    rows = rows.select("repo_id", "path", "content", _places(content, F.col("code")).alias("places"))
    plain = lambda x: x["run"].rlike(r"^[A-Za-z0-9+/=\s]+\z") | x["run"].rlike(r"^[0-9a-fA-F\s]+\z")
    packed = F.get(F.filter(p["packed"], lambda x: ~plain(x) & let(x["run"], lambda r: entropy_of(r) >= BITS)), F.lit(0))
    url = F.regexp_extract(content, URL_MIXED, 0).rlike(MIXED)
    found = lambda id_, severity, at: F.when(at.isNotNull(), F.struct(F.lit(id_).alias("id"), F.lit(severity).alias("severity"), line_of(content, at).cast("int").alias("line")))
    every = F.array(
        found("invisible-characters", "high", p["unseen"]),
        F.coalesce(found("bidi-override", "high", p["turned"]), found("bidi-override", "low", p["turned_comment"])),
        F.when(~url, found("homoglyph-identifier", "low", p["mixed"])),
        # Worked out once, though its place is asked for several times.
        let(packed["at"], lambda at: found("high-entropy-literal", "low", at)),
    )
    return rows.select("repo_id", path.alias("file"), F.explode(F.array_compact(every)).alias("f")).select("repo_id", "f.id", "f.severity", "file", "f.line")
