"""Manifests and lockfiles with the findings they must give, written down apart from the patterns."""

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import dependencies, lockfiles, manifests, shell
from sparkwarden.sources.samples import LOCKS, MANIFESTS, E, lock, pkg

KIND = "repo_id int, path string, content string"


def rows(spark, cases, path):
    return spark.createDataFrame([(k, path, c[0]) for k, c in enumerate(cases)], KIND).repartition(3)


def test_manifests(spark):
    got: dict[int, list] = {}
    for r in manifests.manifest_findings(rows(spark, MANIFESTS, "package.json")).collect():
        got.setdefault(r["repo_id"], []).append((r["id"], r["severity"], r["line"]))
    assert [(c, got.get(k)) for k, c in enumerate(MANIFESTS) if sorted(got.get(k, []), key=str) != sorted(c[1], key=str)] == []


def test_script_references(spark):
    cases = [
        (pkg(scripts={"postinstall": "npm run setup && ./bin/go", "setup": "node -r x scripts/setup.js; sh ../out.sh; bash /abs.sh", "test": "node t.js"}, bin={"w": "./bin/w.js"}),),
        (pkg(bin="cli.js"),),
        ("{",),
    ]
    got = {(r["repo_id"], r["rel"]) for r in manifests.script_references(rows(spark, cases, "a/package.json")).collect()}
    # The word after a flag is taken as the file.
    assert got == {(0, "x"), (0, "bin/go"), (0, "bin/w.js"), (1, "cli.js")}


@pytest.fixture(scope="module")
def locked(spark):
    files = spark.createDataFrame([(k, p, c) for k, (p, c, _) in enumerate(LOCKS)], KIND).repartition(3)
    return lockfiles.lockfile_findings(files).collect()


def test_lockfiles(locked):
    got: dict[int, list] = {}
    for r in locked:
        got.setdefault(r["repo_id"], []).append((r["id"], r["severity"], r["line"]))
    assert [(c, got.get(k)) for k, c in enumerate(LOCKS) if sorted(got.get(k, []), key=str) != sorted(c[2], key=str)] == []


def test_names_of_entries(locked):
    names = {(r["repo_id"], r["name"]) for r in locked if LOCKS[r["repo_id"]][0] in ("yarn.lock", "pnpm-lock.yaml")}
    assert {n for _, n in names} == {"lodash", "evil", "g", "some", "other", "@scope/thing"}


def test_lockfile_against_manifest(spark):
    files = [
        (1, "a/package.json", pkg(dependencies={"lodash": "^4.0.0", "kept": f"https://cdn.{E}/k.tgz", "g": "git+https://github.com/o/g.git"})),
        (1, "a/package-lock.json", lock({"node_modules/lodash": {"resolved": "git+https://github.com/evil/lodash.git"}, "node_modules/kept": {"resolved": f"https://cdn.{E}/k.tgz"}, "node_modules/g": {"resolved": "git+https://github.com/o/g.git"}})),
        (1, "b/package-lock.json", lock({"node_modules/lodash": {"resolved": "git+https://github.com/evil/lodash.git"}})),
    ]
    got = {(r["file"], r["name"], r["id"], r["severity"]) for r in lockfiles.lockfile_findings(spark.createDataFrame(files, KIND)).collect()}
    git = "lockfile-git-dependency"
    assert got == {("a/package-lock.json", "lodash", git, "medium"), ("a/package-lock.json", "lodash", "lockfile-manifest-mismatch", "high"), ("a/package-lock.json", "g", git, "medium"), ("a/package-lock.json", "kept", "lockfile-off-registry", "medium"), ("b/package-lock.json", "lodash", git, "medium")}


def test_a_command_is_worked_out_once(spark):
    rows = spark.createDataFrame([("npm ci",)], "command string").select(shell.dangerous_script(F.upper("command")).alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_what_gives_names_is_read_once_for_the_names_and_once_for_the_rows(spark):
    deps = spark.range(3).select(F.col("id").cast("int").alias("repo_id"), F.lit("package.json").alias("file"), F.concat(F.lit("loadas"), F.col("id").cast("string")).alias("name"))
    assert dependencies.name_findings(deps)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
