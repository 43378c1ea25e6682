"""Rules on repository and account facts. None convicts by itself. Dates are compared with a given time, never with the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
NEW_ACCOUNT_DAYS, FEW_REPOSITORIES, SHELL_REPOSITORIES, BURST_COMMITS = 90, 2, 3, 10
DAY_MS = 86_400_000
LURE = r"crypto|defi|web3|blockchain|wallet|trading|exchange|nft|fintech|(?<![A-Za-z0-9_])ai(?![A-Za-z0-9_])|bot(?![A-Za-z0-9_])"


def _finding(when: Column, id_: str, severity: Column | str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(id_).alias("id"), severity.alias("severity"), F.lit("(repository)").alias("file"), F.lit(None).cast("int").alias("line")))


def context_findings(meta: DataFrame, now: str) -> DataFrame:
    """Rows (repo_id, id, severity, file, line) of the seven rules, one pass over the metadata. now: a timestamp, as text."""
    ms = lambda c: F.unix_millis(c)
    age = F.floor((ms(F.lit(now).cast("timestamp")) - ms(F.col("owner_created_at"))) / DAY_MS)
    few = F.col("owner_public_repos")
    dates = F.filter("commit_dates", lambda d: d.isNotNull())
    burst = (F.size(dates) >= BURST_COMMITS) & (ms(F.array_max(dates)) - ms(F.array_min(dates)) <= DAY_MS)
    owner = F.lower("owner")
    named = F.exists("commit_authors", lambda a: F.lower(a).contains(owner) | owner.contains(F.regexp_replace(F.lower(a), r"\s+", "")))
    theme = F.lower(F.concat_ws(" ", F.col("repo"), F.coalesce("description", F.lit("")), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")))
    found = F.array(
        _finding((age >= 0) & (age < NEW_ACCOUNT_DAYS), "new-account", "medium"),
        _finding(few <= FEW_REPOSITORIES, "single-repo-account", "low"),
        _finding((F.col("owner_type") == "Organization") & (F.col("org_public_members") == 0), "empty-org", F.when(few <= SHELL_REPOSITORIES, "medium").otherwise("low")),
        _finding(F.col("is_fork"), "repo-is-fork", "low"),
        _finding(burst, "commit-burst", "low"),
        _finding((F.col("owner_type") == "User") & (F.size("commit_authors") > 0) & ~named, "author-mismatch", "low"),
        _finding(theme.rlike(LURE), "lure-theme", "low"),
    )
    return meta.select("repo_id", F.explode(F.array_compact(found)).alias("f")).select("repo_id", "f.*")
