"""Reports of a repository's findings: JSON, SARIF 2.1.0, text, and error documents. A report holds REPORTED findings at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.verdicts import REPORTED, exit_code, reported, tallies

TOOL, VERSION = "sparkwarden", "0.1.0"
# What a verdict means, and levels of the interchange format.
MEANING = {"green": "nothing known matched", "yellow": "something needs a look before you run this", "red": "do not run this"}


def _listed(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    text = lambda c: F.col(c) if c in findings.columns else F.lit("").alias(c)
    rows = findings.select("repo_id", "id", "severity", "file", F.col("line").cast("int").alias("line"), text("snippet"), text("why"), text("next"))
    top = reported(rows).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("id", "severity", "file", "line", "snippet", "why", "next").alias("f")))), lambda x: x["f"]).alias("listed"))
    kind = top.schema["listed"].dataType.simpleString()
    out = verdicts.select("repo_id", "verdict").join(top, "repo_id", "left").join(tallies(rows), "repo_id", "left").fillna(0, ["findings", "high", "medium", "low"])
    return out.withColumn("listed", F.coalesce("listed", F.array().cast(kind)))


def json_reports(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (repo_id, report)."""
    meaning = F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv])
    doc = F.struct(
        F.lit(1).alias("schemaVersion"),
        F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("tool"),
        F.struct(F.col("repo_id").cast("string").alias("repo")).alias("repository"),
        F.col("verdict"),
        exit_code(F.col("verdict")).alias("exitCode"),
        meaning[F.col("verdict")].alias("verdictMeaning"),
        F.col("listed").alias("findings"),
        F.struct(F.col("findings"), F.size("listed").alias("listed"), F.struct("high", "medium", "low").alias("severities")).alias("stats"),
    )
    return _listed(findings, verdicts).select("repo_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("report"))


def _uri(path: Column) -> Column:
    one = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    for code, mark in (("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        one = F.replace(one, F.lit(code), F.lit(mark))
    return one


def sarif_reports(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (repo_id, report). A verdict that no finding carries becomes a result of its own."""
    level = lambda s: F.when(s == "high", "error").when(s == "medium", "warning").otherwise("note")
    place = lambda file, line: F.array(F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")))
    results = F.transform(
        "listed",
        lambda f: F.struct(
            f["id"].alias("ruleId"),
            level(f["severity"]).alias("level"),
            F.struct(F.concat_ws(" ", f["why"], F.lit("What to do:"), f["next"]).alias("text")).alias("message"),
            place(F.when(f["file"] == "(repository)", "README.md").otherwise(_uri(f["file"])), F.coalesce(f["line"], F.lit(1))).alias("locations"),
        ),
    )
    own = F.array(F.struct(F.lit(f"{TOOL}-verdict").alias("ruleId"), F.when(F.col("verdict") == "red", "error").otherwise("warning").alias("level"), F.struct(F.concat(F.lit("This repository is "), "verdict").alias("text")).alias("message"), place(F.lit("README.md"), F.lit(1)).alias("locations")))
    results = F.when((F.size("listed") == 0) & (F.col("verdict") != "green"), own).otherwise(results)
    ids = F.array_sort(F.array_distinct(F.transform("listed", lambda f: f["id"])))
    rules = F.transform(ids, lambda i: F.struct(i.alias("id"), F.struct(i.alias("text")).alias("shortDescription"), F.struct(F.get(F.filter("listed", lambda f: f["id"] == i), F.lit(0))["why"].alias("text")).alias("fullDescription")))
    run = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), rules.alias("rules")).alias("driver")).alias("tool"), F.struct("verdict", F.col("repo_id").cast("string").alias("repository")).alias("properties"), results.alias("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return _listed(findings, verdicts).select("repo_id", F.to_json(doc).alias("report"))


def text_reports(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (repo_id, report): the verdict, then a line for each listed finding."""
    line = F.transform("listed", lambda f: F.concat(F.rpad(F.upper(f["severity"]), 6, " "), F.lit("  "), f["id"], F.lit("  "), f["file"], F.when(f["line"].isNotNull(), F.concat(F.lit(":"), f["line"].cast("string"))).otherwise("")))
    more = F.when(F.col("findings") > REPORTED, F.concat(F.lit("\n("), (F.col("findings") - REPORTED).cast("string"), F.lit(" more)"))).otherwise("")
    return _listed(findings, verdicts).select("repo_id", F.concat(F.upper("verdict"), F.when(F.size("listed") > 0, "\n").otherwise(""), F.array_join(line, "\n"), more).alias("report"))


def error_reports(failures: DataFrame) -> DataFrame:
    """failures: repo_id, kind, message. A failed repository keeps a row and is never green."""
    doc = F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("tool"), F.struct(F.col("repo_id").cast("string").alias("repo")).alias("repository"), F.lit("error").alias("verdict"), F.lit(3).alias("exitCode"), F.struct("kind", "message").alias("error"))
    return failures.select("repo_id", F.to_json(doc).alias("report"))
