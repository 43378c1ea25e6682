"""From findings to verdicts: total order, cap, collapsing of weak signals, tallies, and the guards on a second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which low findings count as one signal, and which never move a verdict.
ENCODED_CONTENT = ["base64-blob", "single-line-blob", "encoded-blob-density", "high-entropy-literal"]
INSTALL_SCRIPTS = ["lifecycle-script", "transitive-install-script", "composer-install-script"]
ADVISORY = ["agent-instruction-file", "dynamic-code-execution"]
# Findings that keep a verdict whatever a model says, and how many findings it is shown.
NEVER_CLEARED = ["npmrc-registry-override", "yarnrc-yarnpath", "requirements-custom-index", "manifest-non-registry-dependency", "lockfile-git-dependency", "lockfile-off-registry", "lockfile-manifest-mismatch", "registry-credential"]
SHOWN_TO_MODEL = 20
REPORTED = 200
LOWS_FOR_YELLOW = 3


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def low_key(df: DataFrame) -> Column:
    """What a low finding counts as; null if it doesn't count."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    key = F.when(flag("vendored"), "vendored-artifact").when(flag("manual_tool"), "maintainer-tool").when(flag("test_path"), "test-path")
    key = key.when(F.col("id").isin(ENCODED_CONTENT), "encoded-content").when(F.col("id").isin(INSTALL_SCRIPTS), "install-scripts").otherwise(F.col("id"))
    return F.when((F.col("severity") == "low") & ~F.col("id").isin(ADVISORY), key)


def verdict_of(high: Column, medium: Column, lows: Column) -> Column:
    return F.when(high >= 1, "red").when((medium >= 1) | (lows >= LOWS_FOR_YELLOW), "yellow").otherwise("green")


def decide(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row per repository, also those without findings: repo_id, verdict, high, medium, low_signals, exit_code.

    Findings are first counted by (repo_id, signal), so a repository with very many of them is summed before it meets.
    """
    signals = findings.select("repo_id", "severity", low_key(findings).alias("key")).groupBy("repo_id", "severity", "key").agg(F.count(F.lit(1)).alias("n"))
    counted = signals.groupBy("repo_id").agg(
        F.sum(F.when(F.col("severity") == "high", F.col("n")).otherwise(0)).alias("high"),
        F.sum(F.when(F.col("severity") == "medium", F.col("n")).otherwise(0)).alias("medium"),
        F.count(F.when(F.col("severity") == "low", F.col("key"))).alias("low_signals"),
    )
    out = repositories.select("repo_id").distinct().join(counted, "repo_id", "left").fillna(0, ["high", "medium", "low_signals"])
    out = out.withColumn("verdict", verdict_of(F.col("high"), F.col("medium"), F.col("low_signals")))
    return out.withColumn("exit_code", exit_code(F.col("verdict")))


def exit_code(verdict: Column) -> Column:
    return F.when(verdict == "green", 0).when(verdict == "yellow", 1).when(verdict == "red", 2).otherwise(3)


def report_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("file").asc(), F.coalesce(F.col("line"), F.lit(0)).asc(), F.col("id").asc()]


def reported(findings: DataFrame, most: int = REPORTED, tie: str | None = None) -> DataFrame:
    """The first `most` findings of each repository in report order, with their place from 1."""
    w = Window.partitionBy("repo_id").orderBy(*report_order(), *([F.col(tie)] if tie else []))
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def tallies(findings: DataFrame) -> DataFrame:
    """Findings of each repository by severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"), n("high"), n("medium"), n("low"))


def hidden_kinds(findings: DataFrame, most: int = REPORTED, tie: str | None = None) -> DataFrame:
    """Sorted distinct ids of the findings beyond the cap."""
    w = Window.partitionBy("repo_id").orderBy(*report_order(), *([F.col(tie)] if tie else []))
    rest = findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") > most)
    return rest.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("hidden"), F.count(F.lit(1)).alias("n_hidden"))


def second_opinion(static: Column, model: Column, ids: Column) -> Column:
    """The verdict after a model's: red is a floor, and no model reaches it; some findings are never cleared; unread ones neither."""
    joined = F.when(static == "red", "red").when(~model.isin("red", "yellow", "green") | model.isNull(), static).when(model == "red", "yellow").otherwise(model)
    kept = F.arrays_overlap(ids, F.array(*map(F.lit, NEVER_CLEARED))) | (F.size(ids) > SHOWN_TO_MODEL)
    return F.when((joined == "green") & kept, static).otherwise(joined)
