r"""Quality rules: text statistics as SQL functions, and a decision list learned from labels by sequential covering.

Base rules reject documents of few words or of many words in repeated 8-word windows. For the others an ordered list of
rules decides, each a conjunction of thresholds on statistics ("symbols_per_word > 0.31 AND upper_share <= 0.4"). A rule
is grown condition by condition on two thirds of the labelled rows that no earlier rule covers, by information gain, and
pruned from its end on the last third; covering ends when no rule is precise enough. The list becomes one conditional
expression. Spark counts the labelled rows by the bins of their statistics; growing and pruning only read these counts.

Defined cases: null text has no words. Windows are compared by 64-bit hashes within one text. Rows that share an id are
judged each on its own. Labels that are null, or of unknown documents, are not used; without labels of both kinds no rule
is learned, and the base rules decide alone. Other columns pass through; those that share a name with a result column
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Labelled rows that are fitted on, about; more are thinned out by a hash of their id.
MAX_FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, MIN_COVERED = 12, 3, 3
#: Least share of bad rows among those a rule covers: over all, and over those it was not grown on.
MIN_PRECISION, MIN_HELD = 0.9, 0.8
CUTS = 40

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may use, as SQL.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / _n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "_n_distinct / n_words",
    "upper_share": "_n_upper / word_chars",
    "digit_share": "_n_digits / word_chars",
    "marks_per_word": "_n_marks / n_words",
    "words_per_line": "n_words / _n_lines",
}


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows that the text has twice or more."""
    none = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), none.alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    def repeated(placed: Column) -> Column:
        """Places of windows whose neighbour in hash order is equal."""
        same = lambda x, i: F.coalesce(F.get(placed, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def counted(windows: Column) -> Column:
        # Most texts repeat no window; only the others are sorted.
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(placed, lambda p: _let(repeated(p), covered))).otherwise(none)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, _let(hashes, lambda h: _let(windows(h), counted))).otherwise(none)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base statistics (long) and counts that the features need (names with an underscore)."""
    space = r"[\x20\x09-\x0D]+"
    names = [F.col(f"`{c}`") for c in docs.columns if c not in BASE]
    df = docs.select(*names, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    without = lambda marks: F.length("_t") - F.length(F.translate("_t", marks, ""))
    words = F.filter(F.split("_t", space), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = F.struct(
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).alias("_n_distinct"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).alias("_n_lines"))).alias("l"),
        F.length(F.regexp_replace("_t", space, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_n_upper"),
        without("0123456789").alias("_n_digits"),
        without("!?").alias("_n_marks"),
    )
    # Always true, but not for the optimizer: it would otherwise copy the whole expression to each use of a statistic, and into filters.
    df = df.select(*names, F.when(F.rand(0) >= 0, found).alias("_s"))
    return df.select(*names, "_s.w.*", "_s.l.*", *(F.col("_s")[c].alias(c) for c in ("word_chars", "n_symbols", "_n_upper", "_n_digits", "_n_marks")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return (x > self.cut) if self.above else (x <= self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Features f_* of about max_rows labelled documents at most, bad (quality is 0) and grow (for growing, not pruning)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_q")).filter("_id IS NOT NULL AND _q IS NOT NULL")
    n = marked.count()
    marked = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / max(n, 1)))))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "_id")  # the sample is bounded
    rows = statistics(rows).filter(~base_failed())
    return rows.select((F.col("_q") == 0).alias("bad"), (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) > 0).alias("grow"), *(F.expr(c).alias(f"f_{k}") for k, c in FEATURES.items()))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """FOIL's information gain of a condition that leaves p of p0 bad and n of n0 good rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(rows: DataFrame) -> list[Rule]:
    """A decision list from rows as labelled() gives them.

    Spark finds the cuts and counts rows by the bins they fall into; of these counts there are at most as many as rows in
    the bounded sample.
    """
    rows = written(rows, "labelled_statistics").coalesce(1)  # a bounded sample; only its rereading takes one task
    names = list(FEATURES)
    points = [k / CUTS for k in range(1, CUTS)]
    found = rows.agg(*(F.percentile_approx(F.when(F.col("bad") == bad, F.col(f"f_{c}")), points, 10_000).alias(f"{c}_{bad}") for c in names for bad in (True, False))).first()
    seen = {c: sorted({*(found[f"{c}_True"] or []), *(found[f"{c}_False"] or [])}) for c in names}
    cuts = {c: [(a + b) / 2 for a, b in zip(seen[c], seen[c][1:])] for c in names}  # halfway, to leave a margin on either side

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*(F.lit(x) for x in cuts[c])).cast("array<double>"), lambda x: x < F.col(f"f_{c}")))

    bins = [bin_of(c) for c in names]
    counts = [(r["bins"], r["bad"], r["grow"], r["count"]) for r in rows.groupBy(F.array(*bins).alias("bins"), "bad", "grow").count().collect()]
    place = {c: i for i, c in enumerate(names)}
    at = {(c, x): k for c in names for k, x in enumerate(cuts[c])}

    def holds(rule: Rule, own: list[int]) -> bool:
        return all((own[place[c.feature]] > at[c.feature, c.cut]) == c.above for c in rule)

    def tally(rule: Rule, some: list) -> tuple[int, int]:
        got = [0, 0]
        for own, bad, _, n in some:
            if holds(rule, own):
                got[bad] += n
        return got[1], got[0]

    def grown(some: list) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = tally((), some)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f, c in enumerate(names):
                each = [[0, 0] for _ in range(len(cuts[c]) + 1)]
                for own, bad, _, n in some:
                    each[own[f]][bad] += n
                p, n = p0, n0
                for k, cut in enumerate(cuts[c]):
                    p, n = p - each[k][1], n - each[k][0]  # left above the cut
                    for above, x, y in ((True, p, n), (False, p0 - p, n0 - n)):
                        if (g := _gain(p0, n0, x, y)) > gain:
                            best, gain = Condition(c, above, cut), g
            if best is None:
                break
            rule = (*rule, best)
            some = [x for x in some if holds((best,), x[0])]
        return rule

    def worth(p: int, n: int) -> float:
        return (p - n) / max(1, p + n)

    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (rule := grown([x for x in counts if x[2]])):
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        held = [x for x in counts if not x[2]]
        best = max(prefixes, key=lambda r: (worth(*tally(r, held)), -len(r)))
        p, n = tally(best, counts)
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n) or worth(*tally(best, held)) < 2 * MIN_HELD - 1:
            break
        rules.append(best)
        counts = [x for x in counts if not holds(best, x[0])]
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the base statistics, base_failed, rule (the one that rejects, else null) and kept."""
    own = [c for c in docs.columns if c not in (*BASE, "base_failed", "rule", "kept")]
    df = statistics(docs.select(*(F.col(f"`{c}`") for c in own)), text_col)
    df = df.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), decision(rules)))
    return df.select(*(F.col(f"`{c}`") for c in own), *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(docs, rules).drop("text")
