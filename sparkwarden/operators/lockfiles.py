"""Lockfiles as tables of entries: npm of all versions, yarn classic and berry, pnpm; and what manifests say of the same names.

npm's files are parsed as a VARIANT; the nested tree of the first version is opened level by level. Yarn and pnpm are read
line by line: an entry takes the last header above it, which is a window over the lines of a file. Lines of npm entries
are found by their address, in one pass over the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import directory, host_of
from sparkwarden.operators.dependencies import MALICIOUS, install_script_findings, resolution_findings
from sparkwarden.operators.manifests import DEPTH, REGISTRY_SPEC, entries_of, is_string, known_git_source, object_of, specs, string_of

# Routes, shapes of lines, fields that ask for packages.
NPM, YARN, PNPM = r"(^|/)(package-lock|npm-shrinkwrap)\.json\z", r"(^|/)yarn\.lock\z", r"(^|/)pnpm-lock\.yaml\z"
YARN_HEADER = r'^"?(@?[^\s@"]+)@'
YARN_ADDRESS = r'^\s+resolved\s+"((?:https?:|git)[^"]*)"'
BERRY_ADDRESS = r'^\s+resolution:\s+"[^"]*?@(https?:[^"]+|git(?:\+[a-z]+:|:|@)[^"]+)"'
PNPM_HEADER = r"^\s{2}'?(/?@?[^\s'@:]+(?:@[^\s':]*)?)'?:"
PNPM_ADDRESS, PNPM_REPO = r"\btarball:\s*['\"]?(https?:[^\s'\",}]+)", r"\brepo:\s*['\"]?([^\s'\",}]+)"
ASKING = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies", "requires"]
NPM_ADDRESS = r'"resolved"\s*:\s*"([^"]+)"'


def _lines(files: DataFrame, route: str) -> DataFrame:
    return files.filter(F.col("path").rlike(route) & F.col("content").isNotNull()).select("repo_id", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "text")).select("repo_id", "file", (F.col("at") + 1).alias("line"), "text")


def _below(rows: DataFrame, header: Column) -> DataFrame:
    """rows with name: the last header at or above each line."""
    w = Window.partitionBy("repo_id", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("name", F.coalesce(F.last(header, ignorenulls=True).over(w), F.lit("unknown")))


def yarn_entries(files: DataFrame) -> DataFrame:
    """Rows (repo_id, file, line, name, resolved) of yarn.lock files, classic and berry."""
    text = F.col("text")
    header = F.when(text.rlike(YARN_HEADER), F.regexp_extract(text, YARN_HEADER, 1))
    url = F.when(text.rlike(YARN_ADDRESS), F.regexp_extract(text, YARN_ADDRESS, 1)).when(text.rlike(BERRY_ADDRESS), F.regexp_extract(text, BERRY_ADDRESS, 1))
    return _below(_lines(files, YARN), header).withColumn("resolved", url).filter("resolved IS NOT NULL").select("repo_id", "file", "line", "name", "resolved")


def pnpm_entries(files: DataFrame) -> DataFrame:
    """Rows (repo_id, file, line, name, resolved) of pnpm-lock.yaml files; a repository's address begins with git+."""
    text = F.col("text")
    header = F.when(text.rlike(PNPM_HEADER), F.regexp_replace(F.regexp_replace(F.regexp_extract(text, PNPM_HEADER, 1), "^/", ""), "^(.+)@.*$", "$1"))
    urls = F.array_compact(F.array(F.when(text.rlike(PNPM_ADDRESS), F.regexp_extract(text, PNPM_ADDRESS, 1)), F.when(text.rlike(PNPM_REPO), F.concat(F.lit("git+"), F.regexp_extract(text, PNPM_REPO, 1)))))
    return _below(_lines(files, PNPM), header).select("repo_id", "file", "line", "name", F.explode(urls).alias("resolved"))


def _tree(parsed: Column) -> Column:
    """Entries (path, info) of the nested dependencies of the first version, level by level."""
    kind = "array<struct<path:string,info:variant>>"
    made = lambda prefix, e: F.struct(F.concat(prefix, F.lit("node_modules/"), e["key"]).alias("path"), e["value"].alias("info"))
    zero = F.struct(F.transform(entries_of(parsed, "$.dependencies"), lambda e: made(F.lit(""), e)).alias("nodes"), F.array().cast(kind).alias("found"))

    def step(a: Column, _: Column) -> Column:
        own = F.filter(a["nodes"], lambda n: object_of(n["info"]).isNotNull())
        below = F.flatten(F.transform(own, lambda n: F.transform(entries_of(n["info"], "$.dependencies"), lambda e: made(F.concat(n["path"], F.lit("/")), e))))
        return F.when(F.size(a["nodes"]) > 0, F.struct(below.alias("nodes"), F.concat(a["found"], own).alias("found"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), zero, step, lambda a: a["found"])


def npm_packages(files: DataFrame) -> DataFrame:
    """Rows (repo_id, file, name, resolved, has_install_script, asks) of npm's lockfiles; resolved is null where nothing is fetched.

    asks: the names that an entry asks for; the root project is a row without a name.
    """
    rows = files.filter(F.col("path").rlike(NPM) & F.col("content").isNotNull()).select("repo_id", F.col("path").alias("file"), F.try_parse_json("content").alias("lock"))
    flat = F.transform(entries_of(F.col("lock"), "$.packages"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("info")))
    rows = rows.select("repo_id", "file", F.explode(F.when(object_of(F.col("lock"), "$.packages").isNotNull(), flat).otherwise(_tree(F.col("lock")))).alias("e")).filter(object_of(F.col("e.info")).isNotNull())
    info = F.col("e.info")
    given = F.try_variant_get(info, "$.name", "variant")
    name = F.when(F.col("e.path") != "", F.when(F.coalesce(F.schema_of_variant(given) != "VOID", F.lit(False)), string_of(given)).otherwise(F.element_at(F.split("e.path", "node_modules/"), -1)))
    url = F.try_variant_get(info, "$.resolved", "variant")
    address = F.when(is_string(url), string_of(url))
    local = F.coalesce(F.try_variant_get(info, "$.link", "boolean"), F.lit(False)) | address.startswith("file:") | ~address.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    asks = F.array_distinct(F.concat(*(F.transform(entries_of(info, f"$.{f}"), lambda e: e["key"]) for f in ASKING)))
    return rows.select("repo_id", "file", name.alias("name"), F.when(~local, address).alias("resolved"), F.coalesce(F.try_variant_get(info, "$.hasInstallScript", "boolean"), F.lit(False)).alias("has_install_script"), asks.alias("asks"))


def _npm_lines(files: DataFrame) -> DataFrame:
    rows = _lines(files, NPM).filter(F.col("text").contains('"resolved"'))
    urls = F.regexp_extract_all("text", F.lit(NPM_ADDRESS), F.lit(1))
    return rows.select("repo_id", "file", "line", F.explode(urls).alias("resolved")).groupBy("repo_id", "file", "resolved").agg(F.min("line").alias("line"))


def lockfile_entries(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows (repo_id, file, line, name, resolved) of all lockfiles: what is fetched from where. packages: of npm_packages."""
    npm = packages.filter("name IS NOT NULL AND resolved IS NOT NULL").join(_npm_lines(files), ["repo_id", "file", "resolved"], "left")
    return npm.select("repo_id", "file", "line", "name", "resolved").unionByName(yarn_entries(files)).unionByName(pnpm_entries(files))


def lockfile_findings(files: DataFrame) -> DataFrame:
    """files: repo_id, path, content. Rows (repo_id, id, severity, file, line, name, resolved) of all rules on lockfiles.

    An address that a manifest in the same folder names itself is a caution only; a git address for a name of which the
    manifest asks a range is a conviction of its own.
    """
    packages = npm_packages(files)
    found = resolution_findings(lockfile_entries(files, packages))
    found = found.withColumn("severity", F.when((F.col("id") == "lockfile-git-dependency") & known_git_source(F.col("resolved")), "low").otherwise(F.col("severity")))
    asked = specs(files).groupBy("repo_id", "dir", "name").agg(F.max("spec").alias("spec"))
    both = found.withColumn("dir", directory(F.col("file"))).join(asked, ["repo_id", "dir", "name"], "left")
    shown = F.coalesce((F.col("id") == "lockfile-off-registry") & F.col("spec").rlike("(?i)^https://") & (host_of(F.col("spec")) == host_of(F.col("resolved"))), F.lit(False))
    swapped = F.coalesce((F.col("id") == "lockfile-git-dependency") & F.col("spec").rlike(REGISTRY_SPEC), F.lit(False))
    own = F.struct("id", F.when(shown & (F.col("severity") == "high"), "medium").otherwise(F.col("severity")).alias("severity"))
    pair = F.array_compact(F.array(own, F.when(swapped, F.struct(F.lit("lockfile-manifest-mismatch").alias("id"), F.lit("high").alias("severity")))))
    resolved = both.select("repo_id", F.explode(pair).alias("f"), "file", "line", "name", "resolved").select("repo_id", "f.id", "f.severity", "file", "line", "name", "resolved")
    declared = packages.select("repo_id", "file", F.explode("asks").alias("name"))
    scripts = install_script_findings(packages.filter("name IS NOT NULL").select("repo_id", "file", "name", "has_install_script"), declared)
    malware = packages.filter(F.lower("name").isin(MALICIOUS)).select("repo_id", "file", "name").distinct().withColumn("id", F.lit("known-malicious-package")).withColumn("severity", F.lit("high"))
    unread = files.filter(F.col("path").rlike(NPM) & F.col("content").isNotNull() & object_of(F.try_parse_json("content")).isNull())
    unread = unread.select("repo_id", F.col("path").alias("file"), F.lit(None).cast("string").alias("name"), F.lit("unparseable-lockfile").alias("id"), F.lit("low").alias("severity"))
    plain = scripts.unionByName(malware).unionByName(unread)
    return resolved.unionByName(plain.withColumn("line", F.lit(None).cast("int")).withColumn("resolved", F.lit(None).cast("string")))
