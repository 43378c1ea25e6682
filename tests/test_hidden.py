"""Hidden characters, mixed alphabets and packed literals, with the findings that each file must give."""

import math
import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import hidden
from sparkwarden.sources import carrier
from sparkwarden.sources.samples import HIDDEN as CASES


def test_hidden(spark):
    files = spark.createDataFrame([(k, p, c) for k, (p, c, _) in enumerate(CASES)], "repo_id int, path string, content string").repartition(3)
    got: dict[int, list] = {}
    for r in hidden.hidden_findings(files).collect():
        got.setdefault(r["repo_id"], []).append((r["id"], r["severity"], r["line"]))
    assert [(CASES[k], got.get(k)) for k in range(len(CASES)) if sorted(got.get(k, [])) != sorted(CASES[k][2])] == []


def test_literals_of_a_line():
    long = "x" * 40
    assert hidden.literals(f"a = \"it's\" + '{long}'") == [(13, long)]
    assert hidden.literals(f"don't \"{long}\"\n'{long}'") == [(6, long), (50 - 1, long)]
    assert hidden.literals('"' + "\\\"" * 30 + '"') == [(0, "\\\"" * 30)]


@pytest.mark.parametrize("shape", ['"\\', "'\"`", "​", "‮", "aа ", "a​а"])
def test_hostile_hidden_text_ends_soon(spark, shape):
    text = (shape * (1_000_000 // len(shape)))[:1_000_000]
    began = time.time()
    hidden.hidden_findings(spark.createDataFrame([(1, "a.js", text)], "repo_id int, path string, content string")).collect()
    assert time.time() - began < 20


def test_entropy_of_texts(spark):
    texts = ["", "aaaa", "abab", r"a\.$*+(b", "é😀😀x\0\n", "ab" * 300 + "c"]
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).orderBy("k").select(hidden.entropy_of(F.col("t"))).collect()]
    assert got == pytest.approx(want, abs=1e-12)


def test_entropy_of_a_long_text_ends_soon(spark):
    text = "".join(chr(33 + i * i % 90 + i % 7) for i in range(4_000))
    rows = spark.range(2_000).repartition(4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t"))
    began = time.time()
    assert rows.filter(hidden.entropy_of(F.col("t")) > 1).count() == 2_000
    assert time.time() - began < 20


def test_dealt_samples_are_spread_over_tasks(spark, small):
    rows = carrier.dealt(spark, small, "customer", "c_custkey", [("a.js", "x"), ("b.js", "y")], "path string, content string")
    sizes = [n for n in rows.rdd.mapPartitions(lambda own: [sum(1 for _ in own)]).collect() if n]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
