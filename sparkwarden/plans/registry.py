"""The queries of this library by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import text as tx
from sparkwarden.operators import autorun, configuration, context, dependencies, grading, hidden, lockfiles, manifests, relations, rewrites, selection, shell, signatures, verdicts
from sparkwarden.plans import reports
from sparkwarden.plans import scan as scan_plan
from sparkwarden.sources import carrier, samples
from sparkwarden.streaming import admission

NOW = "2026-01-01 00:00:00"


def files(spark: SparkSession, d: str) -> DataFrame:
    return carrier.table(spark, d, "documents", carrier.FILE_COLUMNS)


def findings(spark: SparkSession, d: str) -> DataFrame:
    return carrier.table(spark, d, "lineitem", carrier.FINDING_COLUMNS)


def repositories(spark: SparkSession) -> DataFrame:
    return spark.range(905).select(F.col("id").cast("int").alias("repo_id"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    m = carrier.table(spark, d, "customer", carrier.META_COLUMNS)
    now = F.lit(NOW).cast("timestamp")
    dates = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.timestamp_seconds(F.unix_seconds(now) - k * 3600 * (F.col("repo_id") % 4)))
    return m.select("repo_id", "owner", "repo", "owner_type", "owner_public_repos", "org_public_members", "is_fork", F.timestamp_seconds(F.unix_seconds(now) - F.col("age_days") * 86400).alias("owner_created_at"), F.array("author").alias("commit_authors"), dates.alias("commit_dates"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("topics"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("client"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), F.col("event_id").alias("seq"))


WINDOW_MS, MOST = 20 * 86_400_000, 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


FINDINGS, FILES = carrier.sql("lineitem", carrier.FINDING_COLUMNS), carrier.sql("documents", carrier.FILE_COLUMNS)
META, TREE = carrier.sql("customer", carrier.META_COLUMNS), carrier.sql("part", carrier.TREE_COLUMNS)
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
RANK = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
LOW_KEY = f"""CASE WHEN severity <> 'low' OR id IN ({quoted(verdicts.ADVISORY)}) THEN NULL WHEN vendored THEN 'vendored-artifact' WHEN test_path THEN 'test-path'
  WHEN id IN ({quoted(verdicts.ENCODED_CONTENT)}) THEN 'encoded-content' WHEN id IN ({quoted(verdicts.INSTALL_SCRIPTS)}) THEN 'install-scripts' ELSE id END"""
VERDICTS = f"""(SELECT r.repo_id, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low_signals, 0) AS low_signals,
  CASE WHEN coalesce(high, 0) >= 1 THEN 'red' WHEN coalesce(medium, 0) >= 1 OR coalesce(low_signals, 0) >= 3 THEN 'yellow' ELSE 'green' END AS verdict
  FROM (SELECT CAST(unnest(range(905)) AS INT) AS repo_id) r LEFT JOIN (
    SELECT repo_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT {LOW_KEY}) AS low_signals FROM {FINDINGS} f GROUP BY repo_id
  ) c ON r.repo_id = c.repo_id)"""


@query("decide_verdict", f"SELECT repo_id, high, medium, low_signals, verdict, CASE verdict WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END AS exit_code FROM {VERDICTS}")
def decide_verdict(spark, d):
    return verdicts.decide(findings(spark, d), repositories(spark))


ORDERED = f"row_number() OVER (PARTITION BY repo_id ORDER BY {RANK} DESC, file, coalesce(line, 0), id, seq)"


# Fewer repositories with more findings each, so that the cap of a report counts.
CROWDED = f"(SELECT * REPLACE (repo_id % 30 AS repo_id) FROM {FINDINGS} f)"


def crowded(spark, d):
    return findings(spark, d).withColumn("repo_id", F.col("repo_id") % 30)


@query("sorted_findings_top", f"SELECT repo_id, place, id, severity, file, line FROM (SELECT *, {ORDERED} AS place FROM {CROWDED} f) WHERE place <= {verdicts.REPORTED}")
def sorted_findings_top(spark, d):
    return verdicts.reported(crowded(spark, d), verdicts.REPORTED, "seq").select("repo_id", F.col("place").cast("long").alias("place"), "id", "severity", "file", "line")


@query("severity_tally", f"SELECT repo_id, count(*) AS findings, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM {FINDINGS} f GROUP BY repo_id")
def severity_tally(spark, d):
    return verdicts.tallies(findings(spark, d))


@query("hidden_kinds", f"SELECT repo_id, string_agg(DISTINCT id, ',' ORDER BY id) AS hidden, count(*) AS n_hidden FROM (SELECT *, {ORDERED} AS place FROM {CROWDED} f) WHERE place > {verdicts.REPORTED} GROUP BY repo_id")
def hidden_kinds(spark, d):
    return verdicts.hidden_kinds(crowded(spark, d), verdicts.REPORTED, "seq")


@query(
    "second_opinion",
    f"""SELECT repo_id, CASE WHEN verdict = 'red' THEN 'red' WHEN model = 'red' THEN 'yellow' WHEN model = 'none' THEN verdict
       WHEN model = 'green' AND (len(ids) > 20 OR list_contains(ids, 'lockfile-off-registry')) THEN verdict ELSE model END AS final
  FROM (SELECT v.repo_id, verdict, CASE v.repo_id % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' ELSE 'none' END AS model,
        CASE WHEN v.repo_id % 6 = 0 THEN ['lockfile-off-registry'] ELSE list_transform(range(v.repo_id % 30), lambda x: 'x') END AS ids FROM {VERDICTS} v)""",
)
def second_opinion(spark, d):
    v = verdicts.decide(findings(spark, d), repositories(spark))
    r = F.col("repo_id") % 4
    model = F.when(r == 0, "red").when(r == 1, "yellow").when(r == 2, "green").otherwise("none")
    ids = F.when(F.col("repo_id") % 6 == 0, F.array(F.lit("lockfile-off-registry"))).otherwise(F.array_repeat(F.lit("x"), F.col("repo_id") % 30))
    return v.select("repo_id", verdicts.second_opinion(F.col("verdict"), model, ids).alias("final"))


@query(
    "context_rules",
    f"""SELECT repo_id, unnest(list_filter([
    CASE WHEN age_days >= 0 AND age_days < 90 THEN 'new-account:medium' END,
    CASE WHEN owner_public_repos <= 2 THEN 'single-repo-account:low' END,
    CASE WHEN owner_type = 'Organization' AND org_public_members = 0 THEN CASE WHEN owner_public_repos <= 3 THEN 'empty-org:medium' ELSE 'empty-org:low' END END,
    CASE WHEN is_fork THEN 'repo-is-fork:low' END,
    CASE WHEN 11 * (repo_id % 4) <= 24 THEN 'commit-burst:low' END,
    CASE WHEN owner_type = 'User' AND NOT (contains(lower(author), owner) OR contains(owner, replace(lower(author), ' ', ''))) THEN 'author-mismatch:low' END,
    CASE WHEN repo IN ('defi-app', 'chatbot') THEN 'lure-theme:low' END], lambda x: x IS NOT NULL)) AS found FROM {META} m""",
)
def context_rules(spark, d):
    return context.context_findings(meta(spark, d), NOW).select("repo_id", F.concat_ws(":", "id", "severity").alias("found"))


def _re2(pattern: str) -> str:
    return re.sub(r"\(\?<![^)]*\)|\(\?!\w[^)]*\)", "", pattern).replace("'", "''")


# Which signature each sample of the carrier must meet, written down apart from the patterns, and in which files of code.
SAMPLE_RULES = """(VALUES (1, 'c2-port-fingerprint', 'high', 'all'), (2, 'beavertail-c2-paths', 'high', 'all'), (3, 'backdoor-command-handlers', 'high', 'all'),
  (5, 'macos-password-phish', 'high', 'all'), (6, 'windows-lolbin-download', 'high', 'all'), (7, 'obfuscator-io', 'medium', 'all'), (8, 'sandbox-evasion', 'low', 'all'),
  (9, 'sandbox-evasion', 'medium', 'all'), (10, 'tunneling-infra', 'medium', 'all'), (11, 'stealer-file-globbing', 'medium', 'all'), (12, 'spyware-dependency', 'medium', 'all'),
  (13, 'remote-desktop-rat', 'high', 'all'), (15, 'exfil-sink', 'medium', 'all'), (16, 'startup-persistence', 'medium', 'all'), (18, 'stealer-file-globbing', 'medium', 'all'),
  (20, 'powershell-encoded-command', 'high', 'all'), (22, 'eval-decoded-blob', 'high', 'interpreted'), (23, 'env-dump-exfiltration', 'high', 'all'),
  (27, 'c2-port-fingerprint', 'high', 'hash comments'), (28, 'backdoor-command-handlers', 'high', 'slash comments'), (29, 'remote-code-execution', 'high', 'all'),
  (30, 'env-dump-exfiltration', 'high', 'all'), (31, 'remote-code-execution', 'medium', 'all'), (32, 'dead-drop-resolver', 'medium', 'all'), (33, 'ssh-backdoor', 'high', 'all'),
  (34, 'ssh-backdoor', 'medium', 'all')) r(sample, id, severity, files)"""
CODE_FILES = f"""(SELECT *, doc_id % {len(carrier.SNIPPETS)} AS sample, CAST(2 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS line
  FROM (SELECT doc_id, text, {carrier.FILE_COLUMNS["repo_id"]} AS repo_id, {carrier.FILE_COLUMNS["path"]} AS path FROM documents) WHERE split_part(path, '.', -1) IN ('js', 'ts', 'py', 'sh', 'go', 'rb'))"""


@query("signature_scan", f"""SELECT repo_id, id, severity, path AS file, line FROM {CODE_FILES} f JOIN {SAMPLE_RULES} ON f.sample = r.sample
  WHERE r.files = 'all' OR (r.files = 'interpreted' AND path NOT LIKE '%.go') OR (r.files = 'hash comments' AND split_part(path, '.', -1) IN ('py', 'sh', 'rb')) OR (r.files = 'slash comments' AND split_part(path, '.', -1) IN ('js', 'ts', 'go'))""")
def signature_scan(spark, d):
    return signatures.signature_findings(files(spark, d)).select("repo_id", "id", "severity", "file", F.col("line").cast("long").alias("line"))


@query("wallet_files", f"""SELECT repo_id, path AS file, CASE sample WHEN 19 THEN 'wallet file' ELSE 'saved passwords of a browser' END AS label, CASE sample WHEN 19 THEN 1 ELSE 2 END::BIGINT AS targets,
  'low' AS severity, line FROM {CODE_FILES} f WHERE sample IN (19, 26)""")
def wallet_files(spark, d):
    return signatures.wallet_files(files(spark, d)).withColumn("targets", F.col("targets").cast("long")).withColumn("line", F.col("line").cast("long"))


@query("entropy_titles", f"SELECT p_partkey, CAST(floor(entropy(c) * 1e6 + 0.5) AS BIGINT) AS micro_bits FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_partkey")
def entropy_titles(spark, d):
    e = signatures.entropy(spark.read.parquet(f"{d}/part.parquet"), ["p_partkey"], "p_name")
    return e.select("p_partkey", F.floor(F.col("entropy") * 1e6 + 0.5).alias("micro_bits"))


@query("blob_shapes", rf"""SELECT repo_id, file, unnest(list_filter([CASE WHEN n > 8000 AND n > 2000 * lines THEN 'single-line-blob' END, CASE WHEN n > 4000 AND 10 * encoded > 4 * n THEN 'encoded-blob-density' END], lambda x: x IS NOT NULL)) AS id
  FROM (SELECT repo_id, path AS file, strlen(content) AS n, 1 + length(content) - length(replace(content, chr(10), '')) AS lines, coalesce(list_sum(list_transform(regexp_extract_all(content, '[A-Za-z0-9+/=]{{100,}}|(?:[0-9a-fA-F]{{2}}){{50,}}'), lambda x: length(x))), 0) AS encoded FROM {FILES} f)""")
def blob_shapes(spark, d):
    return signatures.blob_findings(files(spark, d)).select("repo_id", "file", "id")


_TEST = f"(regexp_matches(file, '{_re2(selection.TEST_DIR)}') OR regexp_matches(file, '[a-z](Tests?|Specs?)\\.[a-z]+\\z'))"
_VENDORED = f"regexp_matches(file, '{_re2(selection.VENDORED_DIR)}')"
STEPPED = f"""(SELECT repo_id, id, file, seq, vendored, {_TEST} AND NOT executable AS test_path,
    CASE WHEN {_TEST} AND NOT executable THEN CASE s2 WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE s2 END ELSE s2 END AS severity
  FROM (SELECT *, CASE WHEN regexp_matches(file, '{_re2(rewrites.CI_DIR)}') AND NOT regexp_matches(file, '{_re2(rewrites.CI_CONFIG)}') AND NOT {_TEST} AND NOT executable AND s1 = 'high' THEN 'medium' ELSE s1 END AS s2
    FROM (SELECT repo_id, id, file, seq, executable, {_VENDORED} AS vendored,
        CASE WHEN {_VENDORED} AND id IN ({quoted(rewrites.VENDOR_NOISE)}) THEN 'low' WHEN {_VENDORED} AND id IN ({quoted(rewrites.LOW_SPECIFICITY)}) AND severity = 'high' THEN 'medium' ELSE severity END AS s1 FROM {FINDINGS} f)))"""


@query("path_downgrades", f"SELECT repo_id, id, file, seq, vendored, test_path, severity FROM {STEPPED}")
def path_downgrades(spark, d):
    return rewrites.by_path(findings(spark, d)).select("repo_id", "id", "file", "seq", "vendored", "test_path", "severity")


@query("payload_in_config", f"SELECT DISTINCT repo_id, file, 'payload-in-config' AS id, 'high' AS severity FROM {STEPPED} WHERE severity = 'high' AND NOT vendored AND regexp_matches(file, '{_re2(selection.PATTERNS['build'])}')")
def payload_in_config(spark, d):
    return rewrites.with_payload_in_config(rewrites.by_path(findings(spark, d))).filter("id = 'payload-in-config'").select("repo_id", "file", "id", "severity")


@query("corroborate", rf"""SELECT repo_id, id, seq, CASE WHEN id = 'typosquat-dependency' AND NOT proof THEN 'low' ELSE severity END AS severity
  FROM (SELECT *, bool_or(id = 'lifecycle-script' OR severity = 'high' OR (id <> 'typosquat-dependency' AND severity = 'medium' AND regexp_matches(id, '{rewrites.INSTALL_EVIDENCE}'))) OVER (PARTITION BY repo_id) AS proof
    FROM (SELECT * REPLACE (CASE WHEN id = 'lifecycle-script' AND repo_id % 3 > 0 THEN 'repo-is-fork' ELSE id END AS id) FROM {FINDINGS} f))""")
def corroborate(spark, d):
    f = findings(spark, d).withColumn("id", F.when((F.col("id") == "lifecycle-script") & (F.col("repo_id") % 3 > 0), "repo-is-fork").otherwise(F.col("id")))
    return rewrites.corroborated(f).select("repo_id", "id", "seq", "severity")


def _selection_sql() -> str:
    depth = "len(string_split(path, '/'))"
    parts = []
    code = f"regexp_matches(path, '{_re2(selection.CODE)}') AND NOT contains(path, 'node_modules/')"
    for number, name, order, quota in selection.QUOTAS:
        fits = f"{code} AND size > 15000" if name == "large" else f"regexp_matches(path, '{_re2(selection.PATTERNS[name])}')" + ("" if name in ("workflow", "readme") else " AND NOT contains(path, 'node_modules/')")
        key = {"depth": depth, "path": "0", "size": "-size"}[order]
        parts.append(f"SELECT repo_id, path, size, {number} AS category, {key} AS key, {quota} AS quota FROM t WHERE {fits}")
    late = f"CASE WHEN regexp_matches(path, '{_re2(selection.TEST_DIR)}') OR regexp_matches(path, '[a-z](Tests?|Specs?)\\.[a-z]+\\z') OR regexp_matches(path, '{_re2(selection.VENDORED_DIR)}') THEN 1 ELSE 0 END"
    parts.append(f"SELECT repo_id, path, size, 11, {late} * 1000000 + {depth}, 0 FROM t WHERE {code}")
    return f"""WITH t AS (SELECT repo_id, path, max(size) AS size FROM {TREE} x GROUP BY repo_id, path), m AS ({' UNION ALL '.join(parts)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, category ORDER BY key, path) AS rank FROM m),
  p AS (SELECT repo_id, path, size, CASE WHEN category = 11 THEN 1 WHEN rank <= quota THEN 0 ELSE 2 END AS phase, category, rank FROM r),
  f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY phase, category, rank) = 1)
  SELECT * FROM (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY phase, category, rank) AS position FROM f) WHERE position <= 150"""


def tree(spark, d):
    return carrier.table(spark, d, "part", carrier.TREE_COLUMNS)


@query("select_files", _selection_sql())
def select_files(spark, d):
    t = tree(spark, d).groupBy("repo_id", "path").agg(F.max("size").alias("size"))
    return selection.selected_files(t).withColumn("position", F.col("position").cast("long"))


@query("byte_budget", f"SELECT repo_id, position, n, before FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY repo_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT repo_id % 2 AS repo_id, doc_id AS position, 10 * length(content) AS n FROM (SELECT doc_id, * FROM (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in carrier.FILE_COLUMNS.items())} FROM documents)))) WHERE before < {selection.MAX_TOTAL_CHARS}")
def byte_budget(spark, d):
    columns = {"position": "doc_id"} | carrier.FILE_COLUMNS
    f = carrier.table(spark, d, "documents", columns).select((F.col("repo_id") % 2).alias("repo_id"), "position", (10 * F.length("content")).cast("long").alias("n"))
    return selection.within_budget(f, selection.MAX_TOTAL_CHARS, "n").select("repo_id", "position", "n", "before")


@query("follow_references", f"""WITH t AS {TREE}, r AS (SELECT DISTINCT repo_id, path AS from_path, CASE ord % 3 WHEN 0 THEN 'app.js' WHEN 1 THEN 'src/app.js' ELSE 'none.js' END AS rel FROM t),
  b AS (SELECT *, regexp_extract(from_path, '^(.*/)?[^/]*$', 1) || rel AS beside FROM r)
  SELECT repo_id, from_path, rel, coalesce(
    (SELECT min(path) FROM t WHERE t.repo_id = b.repo_id AND t.path = b.beside),
    (SELECT min(path) FROM t WHERE t.repo_id = b.repo_id AND t.path = b.rel),
    (SELECT arg_min(path, ord) FROM t WHERE t.repo_id = b.repo_id AND ends_with(t.path, '/' || b.rel))) AS resolved FROM b""")
def follow_references(spark, d):
    t = tree(spark, d)
    rel = F.when(F.col("ord") % 3 == 0, "app.js").when(F.col("ord") % 3 == 1, "src/app.js").otherwise("none.js")
    return selection.followed(t.select("repo_id", F.col("path").alias("from_path"), rel.alias("rel")).distinct(), t)


DEPS, ENTRIES = carrier.sql("orders", carrier.DEPENDENCY_COLUMNS), carrier.sql("orders", carrier.ENTRY_COLUMNS)
_list = lambda xs: "[" + quoted(xs) + "]"


@query("dependency_names", f"""WITH n AS (SELECT DISTINCT name, lower(name) AS l FROM {DEPS} d), s AS (SELECT *, regexp_matches(l, '^@[^/]+/') AS scoped, regexp_replace(l, '[0-9]+$', '') AS bare, CASE WHEN regexp_matches(l, '^@[^/]+/') THEN regexp_extract(l, '^(@[^/]+)/', 1) ELSE l END AS subject FROM n),
  t AS (SELECT unnest({_list(dependencies.POPULAR)}) AS target, unnest(range({len(dependencies.POPULAR)})) AS ord, FALSE AS scoped UNION ALL SELECT unnest({_list(dependencies.SCOPES)}), unnest(range({len(dependencies.SCOPES)})), TRUE),
  c AS (SELECT name, arg_min(target, ord) AS target FROM s JOIN t ON s.scoped = t.scoped AND substr(s.subject, CASE WHEN s.scoped THEN 2 ELSE 1 END, 1) = substr(t.target, CASE WHEN s.scoped THEN 2 ELSE 1 END, 1) AND damerau_levenshtein(s.subject, t.target) = 1 GROUP BY name),
  j AS (SELECT s.name, CASE WHEN l IN ({quoted(dependencies.MALICIOUS)}) THEN 'known-malicious-package' WHEN s.scoped THEN CASE WHEN subject NOT IN ({quoted(dependencies.SCOPES + dependencies.KNOWN_SCOPES)}) AND target IS NOT NULL THEN 'scope-confusion' END
      WHEN bare <> l AND bare IN ({quoted(dependencies.POPULAR)}) THEN 'alias' WHEN l NOT IN ({quoted(dependencies.POPULAR)}) AND length(l) >= 4 AND target IS NOT NULL THEN 'typosquat-dependency' END AS k, target, bare FROM s LEFT JOIN c ON s.name = c.name)
  SELECT d.repo_id, d.file, d.name, CASE k WHEN 'alias' THEN 'typosquat-dependency' ELSE k END AS id, CASE k WHEN 'known-malicious-package' THEN 'high' WHEN 'alias' THEN 'low' ELSE 'medium' END AS severity, CASE k WHEN 'alias' THEN bare WHEN 'known-malicious-package' THEN NULL ELSE target END AS target FROM {DEPS} d JOIN j ON d.name = j.name WHERE k IS NOT NULL""")
def dependency_names(spark, d):
    return dependencies.name_findings(carrier.table(spark, d, "orders", carrier.DEPENDENCY_COLUMNS))


@query("registry_hosts", f"""SELECT repo_id, file, line, name, resolved, id, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file, id ORDER BY line, name, resolved) AS r FROM (
  SELECT *, CASE WHEN resolved LIKE 'http://registry%' THEN 'lockfile-insecure-registry-url' WHEN resolved LIKE 'git+%' OR resolved LIKE '%github.com%' THEN 'lockfile-git-dependency' ELSE 'lockfile-off-registry' END AS id,
    CASE WHEN resolved LIKE 'http://registry%' OR resolved LIKE 'git+%' THEN 'low' WHEN resolved LIKE '%example.invalid%' OR resolved LIKE '%evil%' THEN 'high' ELSE 'medium' END AS severity
  FROM {ENTRIES} e WHERE resolved NOT LIKE 'https://registry.npmjs.org/%' AND resolved NOT LIKE 'https://r3.cnpmjs.org/%')) WHERE id <> 'lockfile-insecure-registry-url' OR r = 1""")
def registry_hosts(spark, d):
    return dependencies.resolution_findings(carrier.table(spark, d, "orders", carrier.ENTRY_COLUMNS))


def _yarn_lines(df: DataFrame) -> DataFrame:
    lines = F.array(F.concat(F.lit('"'), "name", F.lit('@^1.0.0":')), F.lit('  version "1.0.0"'), F.concat(F.lit('  resolved "'), "resolved", F.lit('"')))
    rows = df.select("repo_id", "file", F.col("line").alias("entry"), F.posexplode(lines).alias("k", "text"))
    # Every third entry has no header of its own and takes the last one above.
    return rows.filter("NOT (k = 0 AND entry % 3 = 0)").select("repo_id", "file", (F.col("entry") * 3 + F.col("k")).alias("line"), "text")


@query("yarn_headers", f"""SELECT repo_id, file, line * 3 + 2 AS line, coalesce(last_value(CASE WHEN line % 3 > 0 THEN name END IGNORE NULLS) OVER (PARTITION BY repo_id ORDER BY line ROWS UNBOUNDED PRECEDING), 'unknown') AS name, resolved FROM {ENTRIES} e""")
def yarn_headers(spark, d):
    return dependencies.yarn_entries(_yarn_lines(carrier.table(spark, d, "orders", carrier.ENTRY_COLUMNS)))


@query("install_scripts", """WITH p AS (SELECT CAST(o_custkey % 500 AS INT) AS repo_id, 'package-lock.json' AS file, CASE o_orderkey % 5 WHEN 0 THEN 'esbuild' WHEN 1 THEN '@swc/core' ELSE 'p' || CAST(o_orderkey % 17 AS VARCHAR) END AS name, o_orderkey % 2 = 0 AS h FROM orders)
  SELECT repo_id, file, name, 'transitive-install-script' AS id, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.repo_id = p.repo_id AND q.name = p.name AND NOT q.h) THEN 'low' ELSE 'medium' END AS severity FROM p WHERE h AND name <> 'esbuild' AND name NOT LIKE '@swc/%'""")
def install_scripts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    p = o.select((F.col("o_custkey") % 500).cast("int").alias("repo_id"), F.lit("package-lock.json").alias("file"), F.when(k % 5 == 0, "esbuild").when(k % 5 == 1, "@swc/core").otherwise(F.concat(F.lit("p"), (k % 17).cast("string"))).alias("name"), (k % 2 == 0).alias("has_install_script"))
    return dependencies.install_script_findings(p, p.filter("NOT has_install_script"))


@query("manifest_mismatch", f"""SELECT e.repo_id, e.file, e.name, s.spec, 'lockfile-manifest-mismatch' AS id, 'high' AS severity FROM {ENTRIES} e JOIN (SELECT DISTINCT CAST(c_custkey % 500 AS INT) AS repo_id, 'p' || CAST(c_custkey % 13 AS VARCHAR) AS name, CASE c_custkey % 3 WHEN 0 THEN '^1.2.3' WHEN 1 THEN 'github:o/r' ELSE '~2.x' END AS spec FROM customer) s
  ON e.repo_id = s.repo_id AND e.name = s.name WHERE resolved LIKE 'git+%' AND spec <> 'github:o/r'""")
def manifest_mismatch(spark, d):
    e = carrier.table(spark, d, "orders", carrier.ENTRY_COLUMNS).filter("resolved LIKE 'git+%'").withColumn("dir", tx.directory(F.col("file")))
    c = F.col("c_custkey")
    specs = spark.read.parquet(f"{d}/customer.parquet").select((c % 500).cast("int").alias("repo_id"), F.lit("").alias("dir"), F.concat(F.lit("p"), (c % 13).cast("string")).alias("name"), F.when(c % 3 == 0, "^1.2.3").when(c % 3 == 1, "github:o/r").otherwise("~2.x").alias("spec")).distinct()
    return dependencies.manifest_mismatches(e, specs)


@query("fired_rules", f"SELECT id, max({RANK}) AS severity_rank, count(DISTINCT repo_id) AS repositories FROM {FINDINGS} f GROUP BY id")
def fired_rules(spark, d):
    return grading.fired_rules(findings(spark, d))


@query("detection_rate", f"""SELECT category, count(*) AS samples, count(*) FILTER (ok) AS met, CAST(floor(count(*) FILTER (ok) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent
  FROM (SELECT repo_id % 4 AS category, CASE repo_id % 3 WHEN 0 THEN verdict = 'red' WHEN 1 THEN verdict <> 'green' ELSE verdict = 'green' END AS ok FROM {VERDICTS} v) GROUP BY category""")
def detection_rate(spark, d):
    v = verdicts.decide(findings(spark, d), repositories(spark))
    r = F.col("repo_id") % 3
    return grading.detection(v.select((F.col("repo_id") % 4).alias("category"), F.when(r == 0, "red").when(r == 1, "flag").otherwise("miss").alias("expected"), "verdict"))


@query("unexpected_reds", f"SELECT repo_id, 'unexpected' AS what FROM {VERDICTS} v WHERE verdict = 'red' AND repo_id % 2 = 1 UNION ALL SELECT repo_id, 'missing' FROM {VERDICTS} v WHERE verdict <> 'red' AND repo_id % 2 = 0")
def unexpected_reds(spark, d):
    v = verdicts.decide(findings(spark, d), repositories(spark)).select("repo_id", "verdict")
    expected = repositories(spark).filter("repo_id % 2 = 0")
    return grading.unexpected_reds(v, expected).select("repo_id", F.lit("unexpected").alias("what")).unionByName(grading.missing_reds(v, expected).select("repo_id", F.lit("missing").alias("what")))


@query("comment_blanking", f"SELECT doc_id, list_sum(list_transform(string_split(c, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\s*(?:#|//)(?:\\s|$)') THEN length(x) ELSE 0 END))::BIGINT AS blanked FROM (SELECT doc_id, '# note' || chr(10) || coalesce(text, '') || chr(10) || '  // ' || source AS c FROM documents)")
def comment_blanking(spark, d):
    c = F.concat(F.lit("# note\n"), F.coalesce("text", F.lit("")), F.lit("\n  // "), "source")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", c.alias("c"))
    blank = lambda x: F.length(F.regexp_replace(x, " ", ""))
    out = docs.withColumn("b", tx.blanked_comment_lines(F.col("c"), "#|//"))
    return out.select("doc_id", (blank(F.col("c")) - blank(F.col("b")) + F.lit(1) + F.lit(3)).cast("long").alias("blanked"))


@query("repository_references", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'acme' WHEN 1 THEN 'acme' WHEN 2 THEN 'a-b' END AS owner, CASE o_orderkey % 6 WHEN 0 THEN 'tool' WHEN 1 THEN 'tool' WHEN 2 THEN 'x.y' END AS repo FROM orders""")
def repository_references(spark, d):
    k = F.col("o_orderkey") % 6
    ref = F.when(k == 0, "acme/tool").when(k == 1, "https://github.com/acme/tool.git").when(k == 2, "github.com/a-b/x.y/").when(k == 3, "https://example.invalid/a/b/c").when(k == 4, "acme/..").otherwise("not a repository")
    r = tx.parsed_repository(ref)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", r["owner"].alias("owner"), r["repo"].alias("repo"))


@query("rate_limiter", f"""WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS seq, floor(epoch_us(ts) / 1000)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000), event_id) AS n FROM events),
  r AS (SELECT client, seq, t, n, TRUE AS allowed, [t] AS kept FROM e WHERE n = 1 UNION ALL
    SELECT client, seq, t, n, len(k) < {MOST}, CASE WHEN len(k) < {MOST} THEN list_append(k, t) ELSE k END FROM (SELECT e.client, e.seq, e.t, e.n, list_filter(r.kept, lambda x: e.t - x < {WINDOW_MS}) AS k FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1))
  SELECT client, t AS at_ms, seq, allowed FROM r""")
def rate_limiter(spark, d):
    return admission.admitted(requests(spark, d), WINDOW_MS, MOST).withColumnRenamed("at", "at_ms")


@query("verdict_cache", f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, floor(epoch_us(ts) / 1000)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000), event_id) AS n FROM events),
  r AS (SELECT key, seq, t, n, FALSE AS cached, t AS landed FROM e WHERE n = 1 UNION ALL
    SELECT e.key, e.seq, e.t, e.n, e.t - r.landed < 86400000, CASE WHEN e.t - r.landed < 86400000 THEN r.landed ELSE e.t END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
  SELECT key, t AS at_ms, seq, cached FROM r""")
def verdict_cache(spark, d):
    return admission.served(requests(spark, d).withColumnRenamed("client", "key"), 86_400_000).withColumnRenamed("at", "at_ms")


CONFIG = carrier.sql("customer", carrier.CONFIG_COLUMNS)


def _configuration_sql() -> str:
    parts = []
    for r in configuration.FILE_RULES:
        where = f"regexp_matches(path, '{_re2(r.route)}') AND regexp_matches(content, '{_re2(r.pattern)}')"
        where += f" AND regexp_matches(content, '{_re2(r.also)}')" if r.also else ""
        where += f" AND NOT regexp_matches(content, '{_re2(r.unless)}')" if r.unless else ""
        severity = f"CASE WHEN regexp_matches(content, '{_re2(r.weak_unless)}') THEN '{r.severity}' ELSE 'low' END" if r.weak_unless else f"'{r.severity}'"
        parts.append(f"SELECT repo_id, '{r.id}' AS id, {severity} AS severity, path AS file, 2 AS line FROM f WHERE {where}")
    return f"WITH f AS {CONFIG} " + " UNION ALL ".join(parts)


@query("configuration_files", _configuration_sql())
def configuration_files(spark, d):
    return configuration.file_findings(carrier.table(spark, d, "customer", carrier.CONFIG_COLUMNS))


@query("configuration_lines", f"""SELECT repo_id, id, severity, path AS file, 2 AS line FROM (SELECT *, CASE WHEN path = 'requirements.txt' AND content LIKE '%--index-url%' THEN 'requirements-custom-index' WHEN path = 'requirements.txt' AND content LIKE '%git+https:%' THEN 'requirements-url-dependency'
    WHEN path = '.npmrc' AND content LIKE '%registry = %' AND content NOT LIKE '%npmjs%' THEN 'npmrc-registry-override' WHEN path = '.yarnrc.yml' AND content LIKE '%yarnPath: ./evil%' THEN 'yarnrc-yarnpath' END AS id,
    CASE WHEN path = '.yarnrc.yml' OR content LIKE '%192.0.2.1%' THEN 'high' ELSE 'medium' END AS severity FROM {CONFIG} f) WHERE id IS NOT NULL""")
def configuration_lines(spark, d):
    return configuration.line_findings(carrier.table(spark, d, "customer", carrier.CONFIG_COLUMNS))


@query("agent_instructions", f"""SELECT repo_id, path AS file, 'agent-instruction-file' AS id, CASE WHEN content LIKE '%ignore all previous%' OR content LIKE '%never tell%' THEN 'high' ELSE 'low' END AS severity,
    CASE WHEN content LIKE '%ignore all previous%' THEN 'override' WHEN content LIKE '%never tell%' THEN 'conceal' ELSE 'present' END AS what FROM {CONFIG} f WHERE path = 'AGENTS.md'""")
def agent_instructions(spark, d):
    return configuration.instruction_findings(carrier.table(spark, d, "customer", carrier.CONFIG_COLUMNS), selection.PATTERNS["instructions"])


def scanned(spark, d) -> scan_plan.Scan:
    """The scan of the carrier's repositories."""
    f = carrier.table(spark, d, "documents", carrier.SCAN_COLUMNS)
    return scan_plan.scan(f.select("repo_id", "path", "content"), f.select("repo_id", "ord", "path", F.lit(1000).cast("long").alias("size")), meta(spark, d), NOW)


# What the samples of a repository of the carrier must give, file by file, and what paths, programs and tools make of it.
_N = len(carrier.SNIPPETS)
_CYCLE = lambda path: f"repo_id % {len(carrier.WHOLE[path])}"
EXPECTED = f"""WITH d AS (SELECT doc_id, CAST(doc_id // 24 AS INT) AS repo_id, doc_id % {_N} AS sample, coalesce(text, '') || chr(10) || 'x' AS body, {carrier.SCAN_COLUMNS["path"]} AS path, {carrier._case('doc_id', carrier.SNIPPETS)} AS snippet FROM documents),
  code AS (SELECT *, split_part(path, '.', -1) AS kind FROM d WHERE split_part(path, '.', -1) IN ('js', 'ts', 'py', 'sh', 'go', 'rb')),
  raw AS (
    SELECT repo_id, r.id, r.severity, path AS file FROM code JOIN {SAMPLE_RULES} ON code.sample = r.sample
      WHERE r.files = 'all' OR (r.files = 'interpreted' AND kind <> 'go') OR (r.files = 'hash comments' AND kind IN ('py', 'sh', 'rb')) OR (r.files = 'slash comments' AND kind IN ('js', 'ts', 'go'))
    UNION ALL SELECT repo_id, 'wallet-file-access', 'low', path FROM code WHERE sample IN (19, 26)
    UNION ALL SELECT repo_id, 'single-line-blob', 'low', path FROM code WHERE strlen(body) - 1 + strlen(snippet) > 8000 AND strlen(body) - 1 + strlen(snippet) > 2000 * (1 + length(body) - length(replace(body, chr(10), '')))
    UNION ALL SELECT repo_id, 'lifecycle-script', CASE {_CYCLE("package.json")} WHEN 1 THEN 'high' ELSE 'low' END, path FROM d WHERE path = 'package.json' AND {_CYCLE("package.json")} IN (1, 2)
    UNION ALL SELECT repo_id, 'odd-dependency-mix', 'medium', path FROM d WHERE path = 'package.json' AND {_CYCLE("package.json")} = 3
    UNION ALL SELECT repo_id, 'broken-package-json', 'low', path FROM d WHERE path = 'package.json' AND {_CYCLE("package.json")} = 4
    UNION ALL SELECT repo_id, 'mcp-server-autostart', CASE {_CYCLE(".mcp.json")} WHEN 1 THEN 'high' ELSE 'low' END, path FROM d WHERE path = '.mcp.json' AND {_CYCLE(".mcp.json")} IN (1, 2)
    UNION ALL SELECT repo_id, 'lockfile-off-registry', 'high', path FROM d WHERE path = 'package-lock.json' AND {_CYCLE("package-lock.json")} = 1
    UNION ALL SELECT repo_id, 'workflow-self-hosted-runner', 'low', path FROM d WHERE path = '.github/workflows/ci.yml' AND {_CYCLE(".github/workflows/ci.yml")} = 0
    UNION ALL SELECT repo_id, 'dockerfile-remote-exec', 'high', path FROM d WHERE path = 'Dockerfile' AND {_CYCLE("Dockerfile")} = 1
    UNION ALL SELECT repo_id, 'agent-instruction-file', 'low', path FROM d WHERE path = 'CLAUDE.md'
    UNION ALL SELECT repo_id, split_part(found, ':', 1), split_part(found, ':', 2), '(repository)' FROM ({ORACLES["context_rules"]})),
  tagged AS (SELECT *, file IN ('vendor/lib.js', 'dist/bundle.js') AS vendored, file IN ('tests/app.test.js', 'examples/demo.js', 'src/appTest.js') AS test_path FROM raw),
  bundled AS (SELECT * REPLACE (CASE WHEN vendored AND id IN ({quoted(rewrites.VENDOR_NOISE)}) THEN 'low' WHEN vendored AND id IN ({quoted(rewrites.LOW_SPECIFICITY)}) AND severity = 'high' THEN 'medium' ELSE severity END AS severity) FROM tagged),
  placed AS (SELECT * REPLACE (CASE WHEN (test_path OR file = 'ci/install.sh') AND severity = 'high' THEN 'medium' WHEN test_path AND severity = 'medium' THEN 'low' ELSE severity END AS severity) FROM bundled),
  built AS (SELECT *, FALSE AS manual FROM placed UNION ALL SELECT DISTINCT repo_id, 'payload-in-config', 'high', file, FALSE, FALSE, FALSE FROM placed WHERE file IN ('next.config.js', 'webpack.config.js') AND severity = 'high'),
  started AS (SELECT * REPLACE (CASE WHEN id = 'mcp-server-autostart' AND severity = 'high' AND EXISTS (SELECT 1 FROM d WHERE d.repo_id = b.repo_id AND path = 'src/app.js')
      AND NOT EXISTS (SELECT 1 FROM built o WHERE o.repo_id = b.repo_id AND o.file = 'src/app.js' AND o.severity <> 'low') THEN 'medium' ELSE severity END AS severity) FROM built b),
  judged AS (SELECT * REPLACE (file IN ('ci/install.sh', 'tools/release.sh') AND severity <> 'low' AND id IN ({quoted(relations.CAPABILITIES)}) AS manual) FROM started),
  f AS (SELECT * REPLACE (CASE WHEN manual THEN CASE severity WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS severity) FROM judged)"""
_KEY = f"""CASE WHEN severity <> 'low' OR id IN ({quoted(verdicts.ADVISORY)}) THEN NULL WHEN vendored THEN 'vendored-artifact' WHEN manual THEN 'maintainer-tool' WHEN test_path THEN 'test-path'
  WHEN id IN ({quoted(verdicts.ENCODED_CONTENT)}) THEN 'encoded-content' WHEN id IN ({quoted(verdicts.INSTALL_SCRIPTS)}) THEN 'install-scripts' ELSE id END"""


@query("scan", f"""{EXPECTED}, r AS (SELECT repo_id FROM d UNION SELECT CAST(c_custkey AS INT) FROM customer),
  c AS (SELECT repo_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT {_KEY}) AS low_signals FROM f GROUP BY repo_id),
  v AS (SELECT r.repo_id, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low_signals, 0) AS low_signals FROM r LEFT JOIN c ON r.repo_id = c.repo_id)
  SELECT *, CASE WHEN high >= 1 THEN 'red' WHEN medium >= 1 OR low_signals >= 3 THEN 'yellow' ELSE 'green' END AS verdict, CASE WHEN high >= 1 THEN 2 WHEN medium >= 1 OR low_signals >= 3 THEN 1 ELSE 0 END AS exit_code FROM v""")
def scan(spark, d):
    return scanned(spark, d).verdicts


@query("scan_findings", f"{EXPECTED} SELECT repo_id, id, severity, file FROM f")
def scan_findings(spark, d):
    return scanned(spark, d).findings.select("repo_id", "id", "severity", "file")


def _reported(spark, d) -> tuple[DataFrame, DataFrame]:
    out = scanned(spark, d)
    return out.findings, out.verdicts


@query("json_report")
def json_report(spark, d):
    return reports.json_reports(*_reported(spark, d))


@query("sarif_report")
def sarif_report(spark, d):
    return reports.sarif_reports(*_reported(spark, d))


@query("text_report")
def text_report(spark, d):
    return reports.text_reports(*_reported(spark, d))


FINDING = ["id", "severity", "file", "line"]


def _of_files(own: list[tuple]) -> list[list[tuple]]:
    return [[(i, s, path, line) for i, s, line in found] for path, _, found in own]


@query("shell_downloads", f"""SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 + first_line AS BIGINT) AS line
  FROM documents JOIN (VALUES {', '.join(f'({k}, {n})' for k, (n, _) in enumerate(samples.DOWNLOADS) if n)}) v(k, first_line) ON doc_id % {len(samples.DOWNLOADS)} = k""")
def shell_downloads(spark, d):
    texts = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(samples.DOWNLOADS)], "k int, sample string")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % len(samples.DOWNLOADS)).cast("int").alias("k"))
    docs = docs.join(F.broadcast(texts), "k").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "sample").alias("content"))
    return shell.with_download(docs, "content").filter("download IS NOT NULL").select("doc_id", F.col("download.line").cast("long").alias("line"))


@query("autorun_files", carrier.expected("customer", "c_custkey", _of_files(samples.STARTED), FINDING))
def autorun_files(spark, d):
    own = [(p, c) for p, c, _ in samples.STARTED]
    return autorun.autorun_findings(carrier.dealt(spark, d, "customer", "c_custkey", own, "path string, content string")).select("repo_id", *FINDING)


@query("manifest_rules", carrier.expected("customer", "c_custkey", [[(i, s, "package.json", n) for i, s, n in found] for _, found in samples.MANIFESTS], FINDING))
def manifest_rules(spark, d):
    own = [("package.json", c) for c, _ in samples.MANIFESTS]
    return manifests.manifest_findings(carrier.dealt(spark, d, "customer", "c_custkey", own, "path string, content string")).select("repo_id", *FINDING)


@query("lockfile_rules", carrier.expected("customer", "c_custkey", _of_files(samples.LOCKS), FINDING))
def lockfile_rules(spark, d):
    own = [(p, c) for p, c, _ in samples.LOCKS]
    return lockfiles.lockfile_findings(carrier.dealt(spark, d, "customer", "c_custkey", own, "path string, content string")).select("repo_id", *FINDING)


@query("hidden_characters", carrier.expected("customer", "c_custkey", _of_files(samples.HIDDEN), FINDING))
def hidden_characters(spark, d):
    own = [(p, c) for p, c, _ in samples.HIDDEN]
    return hidden.hidden_findings(carrier.dealt(spark, d, "customer", "c_custkey", own, "path string, content string")).select("repo_id", *FINDING)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
