"""What files of one repository say of each other's findings: programs that were read, tools that only maintainers run, runners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import basename
from sparkwarden.operators.manifests import manifests

STARTED = ["agent-hook-autorun", "mcp-server-autostart"]
# Where builds put what they make; findings that honest tools have, too; where such tools are kept; files that
# something acts on by itself, and scripts that people are told to run.
BUILD_OUTPUT = r"(^|/)(dist|build|out|target|\.next|\.output)/"
CAPABILITIES = [
    "download-and-execute", "python-download-execute", "remote-code-execution", "startup-persistence", "dockerfile-remote-exec", "wallet-file-access", "env-exfiltration", "env-dump-exfiltration", "base64-blob",
    "dynamic-code-execution", "sandbox-evasion", "ssh-backdoor", "tunneling-infra",
]
TOOL_FILE = r"(?i)\.(sh|bash|zsh|ksh|fish|bat|cmd|ps1|psm1)\z|(^|/)(Dockerfile[\w.-]*|Containerfile)\z|\.dockerfile\z|(^|/)(scripts?|tools?|bench|deploy|deployments?|infra|ops|hack|packaging|release|installers?|contrib|misc|dev-?tools|docker|provisioning|ansible|terraform|k8s|helm)/"
ACTS_ALONE = r"(^|/)(\.yarnrc(\.ya?ml)?|\.npmrc|\.pnpmfile\.c?js|\.mcp\.json|Procfile|lefthook\.ya?ml|\.pre-commit-config\.ya?ml|(docker-)?compose(\.[\w-]+)?\.ya?ml|\.envrc)\z|(^|/)\.(vscode|devcontainer|claude|cursor|zed|husky|githooks)/"
RECIPES, README = r"(^|/)(Makefile|GNUmakefile|makefile|[Jj]ustfile)\z", r"(?i)^readme\.(md|txt|rst)\z"
RUN_NAMES = r"^(start|dev|serve|test|build|watch|preview|setup|bootstrap|init|install|prepare|postinstall|preinstall)(:|\z)"
README_RUNS = r"\b(?:npm\s+run|yarn(?:\s+run)?|pnpm(?:\s+run)?|bun\s+run)\s+([\w:.-]+)"
ASKS_FOR_RUNNER = r"(?i)self[- ]hosted runner|register (?:a |the |your )?(?:github )?runner|actions/runners|config\.sh\s+--url"


def relaxed(findings: DataFrame, resolved: DataFrame, read: DataFrame, complete: bool = True) -> DataFrame:
    """Steps started programs down to medium if every one was read and nothing but notes was found in it.

    findings: repo_id, id, severity, file, programs; resolved: repo_id, from_path, rel, resolved; read: repo_id, path. A
    program that is not in a complete listing, where builds put theirs, counts as harmless, too; any other unread one does not.
    """
    asked = findings.filter(F.col("id").isin(STARTED) & (F.col("severity") == "high") & (F.size("programs") > 0)).select("repo_id", "file", F.explode("programs").alias("rel")).distinct()
    named = asked.join(resolved.select("repo_id", F.col("from_path").alias("file"), "rel", "resolved"), ["repo_id", "file", "rel"], "left")
    seen = read.select("repo_id", F.col("path").alias("resolved")).distinct().withColumn("seen", F.lit(True))
    doubt = findings.filter("severity <> 'low'").select("repo_id", F.col("file").alias("resolved")).distinct().withColumn("doubt", F.lit(True))
    named = named.join(seen, ["repo_id", "resolved"], "left").join(doubt, ["repo_id", "resolved"], "left")
    fine = F.coalesce(F.col("seen") & F.col("doubt").isNull(), F.lit(False)) | (F.col("resolved").isNull() & F.lit(complete) & F.col("rel").rlike(BUILD_OUTPUT))
    cleared = named.groupBy("repo_id", "file").agg(F.bool_and(fine).alias("cleared"))
    out = findings.join(cleared, ["repo_id", "file"], "left")
    step = F.col("id").isin(STARTED) & (F.col("severity") == "high") & (F.size("programs") > 0) & F.coalesce("cleared", F.lit(False))
    return out.withColumn("severity", F.when(step, "medium").otherwise(F.col("severity"))).drop("cleared")


def run_instructions(files: DataFrame) -> DataFrame:
    """Rows (repo_id, text): the README, recipes, configuration that acts alone, and scripts that people run or the README names."""
    path = F.col("path")
    whole = files.filter(path.rlike(README) | path.rlike(RECIPES) | path.rlike(ACTS_ALONE)).select("repo_id", F.col("content").alias("text"))
    named = files.filter(path.rlike(README)).select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(README_RUNS), F.lit(1))).alias("name")).distinct().withColumn("told", F.lit(True))
    scripts = manifests(files).select("repo_id", F.explode("scripts").alias("name", "text")).join(named, ["repo_id", "name"], "left")
    return whole.unionByName(scripts.filter(F.col("name").rlike(RUN_NAMES) | F.col("told")).select("repo_id", "text"))


def named_in(instructions: DataFrame) -> DataFrame:
    """Distinct (repo_id, name): all file names that a text of instructions can be read as naming.

    A name ends where a word ends or before a dot, so a word names itself and each of its fronts before a dot. The names
    are met by equality then, never by searching every text for every name.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w.-]+"), F.lit(0)))
    fronts = lambda w: F.transform(F.sequence(F.lit(1), F.size(F.split(w, r"\."))), lambda k: F.array_join(F.slice(F.split(w, r"\."), 1, k), "."))
    return instructions.select("repo_id", F.explode(words).alias("word")).distinct().select("repo_id", F.explode(fronts(F.col("word"))).alias("name")).filter("name <> ''").distinct()


def manual_tools(findings: DataFrame, instructions: DataFrame, started: DataFrame) -> DataFrame:
    """Steps findings of mere capability one down, and marks them manual_tool, in tools below the top that nothing starts or names.

    started: repo_id, path. A file whose name has other characters than letters, digits, _, . and - counts as named.
    """
    able = F.col("id").isin(CAPABILITIES) & F.col("severity").isin("high", "medium") & F.col("file").contains("/") & F.col("file").rlike(TOOL_FILE)
    name = basename(F.col("file"))
    names = named_in(instructions).withColumn("told", F.lit(True))
    runs = started.select("repo_id", F.col("path").alias("file")).distinct().withColumn("run", F.lit(True))
    rows = findings.withColumn("name", name).join(names, ["repo_id", "name"], "left").join(runs, ["repo_id", "file"], "left")
    step = able & F.col("told").isNull() & F.col("run").isNull() & F.col("name").rlike(r"^[\w.-]+\z")
    rows = rows.withColumn("manual_tool", step)
    return rows.withColumn("severity", F.when(step, F.when(F.col("severity") == "high", "medium").otherwise("low")).otherwise(F.col("severity"))).drop("name", "told", "run")


def asked_runners(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A workflow on the owner's own machines is a caution where the README asks the reader to set one up."""
    asks = files.filter(F.col("path").rlike(README) & F.col("content").rlike(ASKS_FOR_RUNNER)).select("repo_id").distinct().withColumn("asks", F.lit(True))
    raised = (F.col("id") == "workflow-self-hosted-runner") & F.coalesce("asks", F.lit(False))
    return findings.join(asks, "repo_id", "left").withColumn("severity", F.when(raised, "medium").otherwise(F.col("severity"))).drop("asks")
