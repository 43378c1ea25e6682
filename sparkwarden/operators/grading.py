"""Grading of verdicts against samples and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.verdicts import severity_rank


def fired_rules(findings: DataFrame) -> DataFrame:
    """Each rule's highest severity and the number of repositories it fired in."""
    return findings.groupBy("id").agg(F.max(severity_rank(F.col("severity"))).alias("severity_rank"), F.count_distinct("repo_id").alias("repositories"))


def met(expected, verdict):
    """red wants red, flag wants red or yellow, miss wants green."""
    return F.when(expected == "red", verdict == "red").when(expected == "flag", verdict.isin("red", "yellow")).when(expected == "miss", verdict == "green")


def detection(graded: DataFrame) -> DataFrame:
    """graded: category, expected, verdict. By category: samples, those met, and their rounded percentage."""
    ok = F.count_if(met(F.col("expected"), F.col("verdict")))
    return graded.groupBy("category").agg(F.count(F.lit(1)).alias("samples"), ok.alias("met"), F.floor(ok * 100 / F.count(F.lit(1)) + 0.5).cast("long").alias("percent"))


def unexpected_reds(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    return verdicts.filter("verdict = 'red'").join(expected.select("repo_id").distinct(), "repo_id", "left_anti")


def missing_reds(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("repo_id").distinct().join(verdicts.filter("verdict = 'red'"), "repo_id", "left_anti")
