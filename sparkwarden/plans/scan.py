"""A scan of many repositories: which files are read, what is found in them, and what the findings say of each other.

A listing is ranked first, so contents are read of selected files only. What was read is stored once, by the kind of its
files, and every family of rules reads the kinds that it has rules for. Files that the repository starts by itself follow
with a budget of their own. Findings, far less than the files, are stored before relations and verdicts read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.operators import autorun, configuration, context, hidden, lockfiles, manifests, relations, rewrites, selection, signatures, verdicts
from sparkwarden.plans.explanations import explained
from sparkwarden.sources.tables import stored

COLUMNS = {"repo_id": "int", "id": "string", "severity": "string", "file": "string", "line": "int", "snippet": "string", "programs": "array<string>"}
#: Kinds of files that are stored apart, by path, the first that fits.
KINDS = [("manifest", manifests.MANIFEST), ("lockfile", f"{lockfiles.NPM}|{lockfiles.YARN}|{lockfiles.PNPM}"), ("started", "|".join(autorun.ROUTES)), ("prose", selection.PATTERNS["instructions"])]


@dataclass
class Scan:
    """Tables of a scan: findings with their explanations, a verdict for each repository, and what was read or left out of it."""

    findings: DataFrame
    verdicts: DataFrame
    coverage: DataFrame


def _kind(path: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def _shaped(*families: DataFrame) -> DataFrame:
    out = None
    for own in families:
        own = own.select(*((F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))
        out = own if out is None else out.unionByName(own)
    return out


def selected(files: DataFrame, tree: DataFrame) -> DataFrame:
    """Files to read first: repo_id, path, content (cut to the cap of a file), position; within the budget of a repository."""
    chosen = selection.selected_files(tree.groupBy("repo_id", "path").agg(F.max("size").alias("size"))).select("repo_id", "path", "position")
    # Searching costs far more than its bytes tell: as many partitions as are set, whatever little they hold.
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_id", "path")
    rows = dealt.join(chosen, ["repo_id", "path"]).withColumn("content", F.substring("content", F.lit(1), F.lit(selection.MAX_FILE_CHARS)))
    lengths = selection.within_budget(rows.select("repo_id", "path", "position", F.length("content").alias("length")))
    return rows.join(lengths.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "path", "content", "position")


def references(read: DataFrame) -> DataFrame:
    """Rows (repo_id, from_path, rel, priority): programs that something starts by itself first, then files of install scripts."""
    own = autorun.autorun_references(read.filter("kind = 'started'")).withColumn("priority", F.lit(0))
    return own.unionByName(manifests.script_references(read.filter("kind = 'manifest'")).withColumn("priority", F.lit(1)))


def followups(resolved: DataFrame, read: DataFrame) -> DataFrame:
    """Rows (repo_id, path, place, dropped): files to read besides, each once; those past the cap are marked as dropped."""
    named = resolved.filter("resolved IS NOT NULL").groupBy("repo_id", F.col("resolved").alias("path")).agg(F.min(F.struct("priority", "from_path", "rel")).alias("first"))
    new = named.join(read.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("first", "path"))
    return new.withColumn("place", place).select("repo_id", "path", "place", (F.col("place") > selection.MAX_FOLLOWED).alias("dropped"))


def scan(files: DataFrame, tree: DataFrame, meta: DataFrame, now: str, popular: list[str] | None = None) -> Scan:
    """files: repo_id, path, content; tree: repo_id, ord, path, size; meta: as context_findings takes it."""
    first = stored(selected(files, tree).withColumn("kind", _kind(F.col("path"))), "selected", by="kind")
    asked = references(first)
    resolved = stored(selection.followed(asked.select("repo_id", "from_path", "rel").distinct(), tree).join(asked, ["repo_id", "from_path", "rel"]), "resolved")
    more = followups(resolved, first)
    reserve = Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    second = files.join(more.filter("NOT dropped"), ["repo_id", "path"]).withColumn("content", F.substring("content", F.lit(1), F.lit(selection.MAX_FILE_CHARS)))
    second = second.withColumn("before", F.coalesce(F.sum(F.length("content")).over(reserve), F.lit(0))).filter(F.col("before") < selection.FOLLOW_CHARS)
    second = stored(second.select("repo_id", "path", "content", F.lit(None).cast("int").alias("position"), _kind(F.col("path")).alias("kind")), "followed", by="kind")
    started = resolved.filter("resolved IS NOT NULL").select("repo_id", F.col("resolved").alias("path")).distinct()

    read = first.unionByName(second)
    kind = lambda *names: read.filter(F.col("kind").isin(*names))
    # Any file that something starts is code, whatever its name; of the others only those that are named like code.
    plain = ~signatures.read_as_code(F.col("path"), F.lit(False))
    unnamed = read.filter(plain & F.col("content").isNotNull()).join(started, ["repo_id", "path"], "left_semi").withColumn("executable", F.lit(True))
    code = read.filter(~plain).withColumn("executable", F.lit(False)).unionByName(unnamed)
    found = stored(_shaped(
        signatures.code_findings(code),
        signatures.blob_findings(code),
        hidden.hidden_findings(code.unionByName(kind("prose").withColumn("executable", F.lit(False)))),
        configuration.file_findings(read),
        configuration.line_findings(kind("started", "other")),
        configuration.instruction_findings(kind("prose"), selection.PATTERNS["instructions"]),
        autorun.autorun_findings(kind("started")),
        manifests.manifest_findings(kind("manifest"), *([popular] if popular else [])),
        lockfiles.lockfile_findings(kind("lockfile", "manifest")),
        context.context_findings(meta, now),
    ), "found")
    flags = started.withColumnRenamed("path", "file").withColumn("executable", F.lit(True))
    found = found.join(flags, ["repo_id", "file"], "left").fillna(False, ["executable"])
    found = stored(relations.asked_runners(rewrites.with_payload_in_config(rewrites.by_path(found)), read), "findings")
    found = relations.relaxed(found, resolved, read)
    instructions = relations.run_instructions(read.filter("kind <> 'lockfile'"))
    found = stored(rewrites.corroborated(relations.manual_tools(found, instructions, started)), "judged")
    found = explained(found).fillna("", ["snippet"])

    repositories = tree.select("repo_id").unionByName(meta.select("repo_id"))
    return Scan(found, verdicts.decide(found, repositories), coverage(first, second, more, resolved))


def coverage(first: DataFrame, second: DataFrame, more: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per repository: files and characters read, files without text, follow-ups past the cap, and programs that no file has."""
    count = lambda c: F.count_if(c).cast("long")
    own = first.unionByName(second).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), count(F.col("content").isNull()).alias("unreadable"))
    past = more.groupBy("repo_id").agg(count(F.col("dropped")).alias("dropped"))
    lost = resolved.groupBy("repo_id").agg(count(F.col("resolved").isNull()).alias("unresolved"))
    return own.join(past, "repo_id", "left").join(lost, "repo_id", "left").fillna(0, ["dropped", "unresolved"])
