import datetime as dt
import json
import random
import threading
import time

import pytest

from pyspark.sql import functions as F

from sparkwarden.functions import text as tx
from sparkwarden.operators import context, dependencies, rewrites, selection, signatures, verdicts
from sparkwarden.plans import reports
from sparkwarden.sources import repositories
from sparkwarden.streaming import admission

FINDING = "repo_id int, id string, severity string, file string, line int"


def test_verdict_truth_table(spark):
    cases = {
        0: [("a", "high")],
        1: [("a", "medium")],
        2: [("a", "low"), ("b", "low")],
        3: [("a", "low"), ("b", "low"), ("c", "low")],
        4: [("base64-blob", "low"), ("single-line-blob", "low"), ("high-entropy-literal", "low")],
        5: [("agent-instruction-file", "low"), ("dynamic-code-execution", "low"), ("x", "low"), ("y", "low")],
        6: [("lifecycle-script", "low"), ("transitive-install-script", "low"), ("z", "low")],
        7: [],
    }
    rows = [(r, i, s, "f", None) for r, own in cases.items() for i, s in own]
    repos = spark.createDataFrame([(r,) for r in cases], "repo_id int")
    got = {r["repo_id"]: r["verdict"] for r in verdicts.decide(spark.createDataFrame(rows, FINDING), repos).collect()}
    assert got == {0: "red", 1: "yellow", 2: "green", 3: "yellow", 4: "green", 5: "green", 6: "green", 7: "green"}


def test_verdict_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.choice(["a", "b", "c", "base64-blob"]), rng.choice(["low", "low", "low", "medium"]), "f", None) for _ in range(200)]
    repos = spark.range(20).select(F.col("id").cast("int").alias("repo_id"))
    one = sorted(verdicts.decide(spark.createDataFrame(rows, FINDING).repartition(1), repos).collect())
    rng.shuffle(rows)
    assert one == sorted(verdicts.decide(spark.createDataFrame(rows, FINDING).repartition(7), repos).collect())


def test_context_rules_at_their_edges(spark):
    now = dt.datetime(2026, 1, 1)
    day = dt.timedelta(days=1)
    kind = "repo_id int, owner string, repo string, owner_type string, owner_public_repos int, org_public_members int, is_fork boolean, owner_created_at timestamp, commit_authors array<string>, commit_dates array<timestamp>, description string, topics array<string>"
    rows = [
        (1, "ann", "x", "User", None, None, False, now - 90 * day, ["Ann B"], [now] * 9, None, None),
        (2, "ann", "x", "User", 0, None, True, now - 89 * day, ["Zed"], [now - day] * 5 + [now] * 5, "an AI thing", []),
        (3, "org", "botany", "Organization", 3, 0, None, now + day, [], [], None, ["wallet"]),
        (4, "org", "x", "Organization", 4, 0, False, None, None, None, None, []),
    ]
    got = {}
    for r in context.context_findings(spark.createDataFrame(rows, kind), "2026-01-01 00:00:00").collect():
        got.setdefault(r["repo_id"], set()).add((r["id"], r["severity"]))
    assert got == {
        2: {("new-account", "medium"), ("single-repo-account", "low"), ("repo-is-fork", "low"), ("commit-burst", "low"), ("author-mismatch", "low"), ("lure-theme", "low")},
        3: {("empty-org", "medium"), ("lure-theme", "low")},
        4: {("empty-org", "low")},
    }


def test_quotas_and_overflow(spark):
    paths = [f"p{i}/package.json" for i in range(6)] + ["package.json", "a.js", "tests/b.js", "README.md", "node_modules/x/package.json"]
    tree = spark.createDataFrame([(1, p, 10) for p in paths], "repo_id int, path string, size long")
    got = [r["path"] for r in selection.selected_files(tree).orderBy("position").collect()]
    assert got == ["package.json", "p0/package.json", "p1/package.json", "p2/package.json", "README.md", "a.js", "tests/b.js", "p3/package.json", "p4/package.json", "p5/package.json"]


def test_one_edit(spark):
    pairs = [("lodash", "loadash"), ("axios", "axois"), ("react", "react"), ("react", "raect"), ("abc", "cba"), ("ab", "ba"), ("abcd", "abdc"), ("chalk", "chlk"), ("chalk", "chlak"), ("abcd", "badc")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(F.coalesce(tx.one_edit_apart(F.col("a"), F.col("b")), F.lit(False))).collect()]
    assert got == [True, True, False, True, False, True, True, True, True, False]


def test_signatures_and_their_options(spark):
    files = [(1, "a.js", "x\nssh_cmd ssh_cmd"), (2, "a.js", "x\ny ssh_cmd ssh_run"), (3, "a.js", "exec(requests.get(u).text)"), (4, "a.py", "exec(requests.get(u).text)"), (5, "a.js", "qemu vmware"), (6, "a.js", "qemu vmware dmidecode"), (7, "a.js", "a 192.0.2.1:1244")]
    got = {(r["repo_id"], r["id"], r["severity"], r["line"]) for r in signatures.signature_findings(spark.createDataFrame(files, "repo_id int, path string, content string")).collect()}
    assert got == {(2, "backdoor-command-handlers", "high", 2), (4, "python-download-execute", "high", 1), (5, "sandbox-evasion", "low", 1), (6, "sandbox-evasion", "medium", 1), (7, "c2-port-fingerprint", "high", 1)}


@pytest.mark.parametrize("shape", ["a", "certutil ", '"', "display dialog ", "\n", " ", "\t", "\r", " \n", "# ", "//\n", ".ssh/id_rsa "])
def test_hostile_text_ends_soon(spark, shape):
    """A file of a million characters of one shape; a search that does not end is cancelled."""
    files = spark.createDataFrame([(1, "a.js", (shape * (1_000_000 // len(shape) + 1))[:1_000_000])], "repo_id int, path string, content string")
    spark.sparkContext.setJobGroup("hostile", shape, interruptOnCancel=True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("hostile"))
    stop.start()
    try:
        signatures.wallet_files(files).count()
        began = time.time()
        signatures.signature_findings(files).count()
        assert time.time() - began < 15
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_path_steps_do_not_stack(spark):
    rows = [(1, "x", "high", "tests/a.js", None), (1, "base64-blob", "high", "vendor/a.js", None), (1, "x", "high", "ci/a.sh", None), (1, "x", "high", "ci/a.yml", None), (1, "eval-decoded-blob", "high", "dist/a.js", None)]
    df = spark.createDataFrame(rows, FINDING).withColumn("executable", F.lit(False))
    got = {r["file"]: r["severity"] for r in rewrites.by_path(df).collect()}
    assert got == {"tests/a.js": "medium", "vendor/a.js": "low", "ci/a.sh": "medium", "ci/a.yml": "high", "dist/a.js": "medium"}


def test_registry_lookalikes(spark):
    urls = ["https://r9.cnpmjs.org/x", "https://cnpmjs.org.evil.invalid/x", "https://REGISTRY.npmjs.org/x"]
    df = spark.createDataFrame([(1, "l", i, "p", u) for i, u in enumerate(urls)], "repo_id int, file string, line int, name string, resolved string")
    assert [(r["line"], r["severity"]) for r in dependencies.resolution_findings(df).collect()] == [(1, "high")]


def test_limiter_batch_equals_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((f"c{rng.randrange(4)}", rng.randrange(2_000_000), i) for i in range(200))
    df = spark.createDataFrame(rows, "client string, at long, seq long")
    kept, want = {}, {}
    for c, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        own = [t for t in kept.get(c, []) if at - t < 600_000]
        want[i] = len(own) < 10
        kept[c] = own + [at] if want[i] else own
    assert {r["seq"]: r["allowed"] for r in admission.admitted(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = admission.admitted_stream(stream, expire=False).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert {r["seq"]: r["allowed"] for r in spark.table("admitted").collect()} == want


def test_reports(spark):
    f = spark.createDataFrame([(1, "b", "low", "a b/#x?.js", None), (1, "a", "high", "(repository)", 3)], FINDING)
    v = spark.createDataFrame([(1, "red"), (2, "yellow"), (3, "green")], "repo_id int, verdict string")
    doc = {r[0]: json.loads(r[1]) for r in reports.json_reports(f, v).collect()}
    assert [x["id"] for x in doc[1]["findings"]] == ["a", "b"] and doc[1]["findings"][1]["line"] is None and doc[3]["exitCode"] == 0
    sarif = {r[0]: json.loads(r[1])["runs"][0] for r in reports.sarif_reports(f, v).collect()}
    places = [x["locations"][0]["physicalLocation"] for x in sarif[1]["results"]]
    assert [p["artifactLocation"]["uri"] for p in places] == ["README.md", "a%20b/%23x%3F.js"]
    assert sarif[2]["results"][0]["level"] == "warning" and sarif[3]["results"] == []
    text = {r[0]: r[1] for r in reports.text_reports(f, v).collect()}
    assert text[1].splitlines()[0] == "RED" and text[3] == "GREEN"
    failed = reports.error_reports(spark.createDataFrame([(9, "not-found", "gone")], "repo_id int, kind string, message string")).collect()
    assert json.loads(failed[0][1])["exitCode"] == 3


def test_checked_out_folder(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "src" / "a.js").write_text("let é = 1")
    (tmp_path / "r1" / "b.bin").write_bytes(b"a\0b")
    got = {r["path"]: (r["repo_id"], r["content"]) for r in repositories.checked_out(spark, str(tmp_path)).collect()}
    assert got == {"src/a.js": ("r1", "let é = 1"), "b.bin": ("r1", None)}


def test_fences(spark):
    df = spark.createDataFrame([("a\n```\nb\n```\nc",)], "t string")
    assert df.select(tx.outside_fences(F.col("t"))).first()[0] == "a\nc"


def test_entropy_of_keys_shuffles_texts_not_characters(spark):
    rows = [(1, "aab"), (1, "b😀"), (2, "xxxx"), (3, None), (4, ""), (5, "abcd"), (5, None)]
    df = signatures.entropy(spark.createDataFrame(rows, "k int, t string"), ["k"], "t")
    got = {r["k"]: round(r["entropy"], 9) for r in df.collect()}
    assert got == {1: round(2 * 0.4 * 1.3219280948873624 + 0.2 * 2.321928094887362, 9), 2: 0.0, 5: 2.0}
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
