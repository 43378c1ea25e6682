"""Severity rewrites: what a file's path says of its findings, and what a repository's findings say of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.operators.selection import PATTERNS, TEST_DIR, VENDORED_DIR
from sparkwarden.operators.signatures import SIGNATURES
from sparkwarden.operators.verdicts import severity_rank

# Findings about a file's shape, and weak ones in bundles.
VENDOR_NOISE = ["hex-obfuscation", "dynamic-code-execution", "base64-blob", "single-line-blob", "encoded-blob-density", "high-entropy-literal", "invisible-characters", "private-use-steganography", "bidi-override", "sandbox-evasion", "download-and-execute"]
# Weak in bundles: these, and the signatures that say so of themselves.
LOW_SPECIFICITY = sorted({*VENDOR_NOISE, *(s.id for s in SIGNATURES if s.bundled)})
CI_DIR = r"(?i)^(\.docker|docker|\.buildkite|\.github|\.circleci|\.gitlab|ci|\.ci|\.ci-scripts|\.argoci|\.semaphore|\.cirrus|\.travis|\.drone|\.jenkins|\.teamcity|\.azure-pipelines|build_tools)/|^eng/"
CI_CONFIG = r"(?i)\.ya?ml\z|(^|/)(Jenkinsfile|Makefile)\z"
INSTALL_EVIDENCE = r"^(lifecycle-script|transitive-install-script|manifest-|lockfile-|npm-alias-mismatch|known-malicious-package|scope-confusion|npmrc-|new-account|empty-org)"


def in_tests(path: Column) -> Column:
    return path.rlike(TEST_DIR) | path.rlike(r"[a-z](Tests?|Specs?)\.[a-z]+\z")


def by_path(findings: DataFrame) -> DataFrame:
    """Steps findings in bundles, CI scripts and tests down, in this order, and tags them vendored and test_path.

    findings: repo_id, id, severity, file, executable. A file that an install script runs keeps its severity outside bundles.
    """
    file, id_ = F.col("file"), F.col("id")
    idle = ~F.coalesce(F.col("executable"), F.lit(False))
    vendored = file.rlike(VENDORED_DIR)
    s = F.col("severity")
    s = F.when(vendored & id_.isin(VENDOR_NOISE), "low").when(vendored & id_.isin(LOW_SPECIFICITY) & (s == "high"), "medium").otherwise(s)
    df = findings.withColumn("severity", s).withColumn("vendored", vendored)
    s, tests = F.col("severity"), in_tests(file)
    df = df.withColumn("severity", F.when(file.rlike(CI_DIR) & ~file.rlike(CI_CONFIG) & ~tests & idle & (s == "high"), "medium").otherwise(s))
    s = F.col("severity")
    return df.withColumn("test_path", tests & idle).withColumn("severity", F.when(tests & idle & (s == "high"), "medium").when(tests & idle & (s == "medium"), "low").otherwise(s))


def with_payload_in_config(findings: DataFrame) -> DataFrame:
    """findings and one more, high, for each build configuration that still has a high finding and is no bundle."""
    hot = findings.filter(F.col("file").rlike(PATTERNS["build"]) & ~F.col("vendored") & (F.col("severity") == "high")).select("repo_id", "file").distinct()
    return findings.unionByName(hot.select("repo_id", "file", F.lit("payload-in-config").alias("id"), F.lit("high").alias("severity"), F.lit(False).alias("vendored")), allowMissingColumns=True)


def corroborated(findings: DataFrame) -> DataFrame:
    """Lookalike names are only a note unless something else in the repository is about installing."""
    other = (F.col("id") == "lifecycle-script") | (F.col("severity") == "high") | ((F.col("id") != "typosquat-dependency") & (F.col("severity") == "medium") & F.col("id").rlike(INSTALL_EVIDENCE))
    proof = findings.groupBy("repo_id").agg(F.max(other).alias("proof"))
    df = findings.join(proof, "repo_id")
    return df.withColumn("severity", F.when((F.col("id") == "typosquat-dependency") & ~F.col("proof"), "low").otherwise(F.col("severity"))).drop("proof")


def worst_line(lines: DataFrame) -> DataFrame:
    """The line of each file with the highest severity, the first among equals."""
    w = Window.partitionBy("repo_id", "file").orderBy(severity_rank(F.col("severity")).desc(), "line")
    return lines.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
