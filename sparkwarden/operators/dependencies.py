"""Rules on dependency names and lockfile entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import host_of, one_edit_apart

# Names that were removed from the registry as malware.
MALICIOUS = [
    "require", "crossenv", "cross-env.js", "loadash", "lodahs", "electorn", "expresss", "axois", "mongose", "reactt", "babelcli", "node-fetchs", "node-fetch2", "web3-essential", "ethers-provider2", "ethers-providerz", "solana-web3js",
    "discordjs-api", "sync-request-legacy", "main-util-validation", "node-nvm-ssh", "passports-js", "bcrypts-js", "blockscan-api", "metamask-api", "react-router-html", "react-redirect-router", "vite-plugin-react-ping", "vvite-plugin-react",
    "webpack-css-branch-loader", "nodemailer-helper", "nodemon-pkg", "http-helmet", "morgan-logger", "dotevn", "boby-parser", "boby_parser", "vaildator", "truffel", "ganacche", "foudry", "epxres", "epxreso", "we3.js", "wb3.js", "ethres.js", "ethes.js",
]
#: A short list of much used names; a longer one, such as the registry's own ranking, is passed as parameter.
POPULAR = ["lodash", "react", "react-dom", "chalk", "commander", "express", "axios", "moment", "uuid", "yargs", "glob", "dotenv", "webpack", "typescript", "eslint", "jest", "mocha", "nodemon", "body-parser", "mongoose", "validator", "ethers", "web3", "next", "vite", "zod", "cli-table"]
# Scopes that are trusted as such, and scopes one letter from them that are their own.
SCOPES = [
    "@types", "@babel", "@angular", "@vue", "@aws-sdk", "@azure", "@google-cloud", "@typescript-eslint", "@eslint", "@jest", "@testing-library", "@storybook", "@emotion", "@mui", "@material-ui", "@chakra-ui", "@radix-ui", "@headlessui",
    "@heroicons", "@fortawesome", "@tailwindcss", "@nestjs", "@next", "@sveltejs", "@remix-run", "@tanstack", "@reduxjs", "@apollo", "@graphql", "@octokit", "@sentry", "@prisma", "@swc", "@esbuild", "@rollup", "@vitejs",
    "@playwright", "@cypress", "@docusaurus", "@expo", "@react-native", "@react-navigation", "@solana", "@ethersproject", "@openzeppelin", "@polkadot", "@walletconnect", "@metamask", "@shopify", "@stripe", "@slack",
    "@discordjs", "@actions", "@npmcli", "@commitlint", "@changesets", "@opentelemetry", "@smithy", "@firebase", "@supabase", "@trpc", "@clerk", "@nuxtjs", "@nuxt", "@mux", "@vercel", "@astrojs", "@sanity", "@datadog",
]
KNOWN_SCOPES = ["@mdi", "@mdn", "@bazel", "@graphiql", "@vinejs"]
# Hosts of registries.
REGISTRY_HOSTS = ["registry.npmjs.org", "registry.yarnpkg.com", "npm.jsr.io", "registry.npmmirror.com", "registry.npm.taobao.org", "registry.npmjs.com", "registry.nlark.com", "mirrors.cloud.tencent.com", "mirrors.tencent.com", "registry.npmmirror.org", "r.cnpmjs.org", "registry.cnpmjs.org"]
REGISTRY_DOMAINS = ["cnpmjs.org", "npmmirror.com"]
OFFICIAL_TARBALL_HOSTS = ["cdn.sheetjs.com"]
HOSTED_FEED = r"(?i)(^|\.)pkgs\.dev\.azure\.com\z|\.pkgs\.visualstudio\.com\z|\.jfrog\.io\z|^npm\.pkg\.github\.com\z|^npm\.cloudsmith\.io\z|^gitlab\.com\z"
INTERNAL_HOST = r"(?i)\.(local|internal|corp|lan|intranet|home)\z|^localhost\z|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\."
GIT_HOST = r"(?i)(^|\.)(github\.com|gitlab\.com|bitbucket\.org)\z"
# Packages known to build or fetch something when they are installed.
INSTALL_SCRIPT_NAMES = [
    "esbuild", "sharp", "puppeteer", "playwright", "cypress", "node-sass", "sqlite3", "better-sqlite3", "bcrypt", "fsevents", "core-js", "core-js-pure", "canvas", "grpc", "husky", "sentry-cli", "electron", "node-gyp",
    "prebuild-install", "node-pre-gyp", "cwebp-bin", "mozjpeg", "pngquant-bin", "gifsicle", "optipng-bin", "phantomjs-prebuilt", "chromedriver", "geckodriver", "protobufjs", "nodemon", "workerd", "argon2", "keytar",
    "leveldown", "re2", "swc", "dtrace-provider", "unix-dgram", "bufferutil", "utf-8-validate", "msgpackr-extract", "ssh2", "cpu-features", "iltorb", "deasync", "libpq", "zeromq", "serialport", "usb", "spawn-sync", "es5-ext",
    "nx", "dprint", "@vscode/vsce-sign", "@apollo/protobufjs", "playwright-chromium", "playwright-firefox", "playwright-webkit", "unrs-resolver", "vue-demi", "mongodb-memory-server", "@fortawesome/fontawesome-free", "yarn",
]
INSTALL_SCRIPT_PREFIXES = ["@esbuild/", "@swc/", "@sentry/", "@parcel/", "@prisma/", "@img/", "@napi-rs/", "@node-rs/", "esbuild-", "turbo-", "workerd-", "@playwright/", "@serialport/"]


def name_findings(deps: DataFrame, popular: list[str] = POPULAR, malicious: list[str] = MALICIOUS, scopes: list[str] = SCOPES) -> DataFrame:
    """deps: repo_id, file, name. Rows (repo_id, file, name, id, severity, target): each name's one finding.

    A distinct name is judged once, however many repositories have it; lookalikes are joined on the first letter, which
    an imitation keeps, and the first name in the list wins.
    """
    spark = deps.sparkSession
    names = deps.select("name").distinct().withColumn("lower", F.lower("name"))
    targets = spark.createDataFrame([(i, t, t[0], False) for i, t in enumerate(popular)] + [(i, t, t[1], True) for i, t in enumerate(scopes)], "ord int, target string, letter string, scoped boolean")
    scoped = F.col("lower").rlike("^@[^/]+/")
    subject = F.when(scoped, F.regexp_extract("lower", "^(@[^/]+)/", 1)).otherwise(F.col("lower"))
    letter = F.when(scoped, F.substring("lower", 2, 1)).otherwise(F.substring("lower", 1, 1))
    bare = F.regexp_replace("lower", r"\d+\z", "")
    names = names.withColumn("scoped", scoped).withColumn("subject", subject).withColumn("letter", letter).withColumn("bare", bare)
    names = names.withColumn("alias", ~F.col("scoped") & (F.col("bare") != F.col("lower")) & F.col("bare").isin(popular))
    exempt = F.col("lower").isin(malicious) | F.col("alias") | F.when(F.col("scoped"), F.col("subject").isin(scopes + KNOWN_SCOPES)).otherwise(F.col("lower").isin(popular) | (F.length("lower") < 4))
    # An outer join, so that what gives the names is read once for the judgement.
    near = ~F.col("exempt") & one_edit_apart(F.col("subject"), F.col("target"))
    judged = names.withColumn("exempt", exempt).join(F.broadcast(targets), ["letter", "scoped"], "left").groupBy("name", "lower", "scoped", "bare", "alias").agg(F.min_by("target", F.when(near, F.col("ord"))).alias("target"))
    id_ = F.when(F.col("lower").isin(malicious), "known-malicious-package").when(F.col("scoped") & F.col("target").isNotNull(), "scope-confusion").when(F.col("alias") | F.col("target").isNotNull(), "typosquat-dependency")
    severity = F.when(F.col("lower").isin(malicious), "high").when(F.col("alias"), "low").otherwise("medium")
    judged = judged.select("name", id_.alias("id"), severity.alias("severity"), F.when(F.col("alias"), F.col("bare")).otherwise(F.col("target")).alias("target")).filter("id IS NOT NULL")
    return deps.join(judged, "name").select("repo_id", "file", "name", "id", "severity", "target")


def is_registry(host: Column) -> Column:
    out = host.isin(REGISTRY_HOSTS)
    for d in REGISTRY_DOMAINS:
        out = out | (host == d) | host.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def resolution_findings(entries: DataFrame) -> DataFrame:
    """entries: repo_id, file, line, name, resolved. Rows with id and severity of those that come from elsewhere than a registry."""
    url = F.col("resolved")
    rows = entries.withColumn("host", host_of(url)).withColumn("registry", is_registry(F.col("host")))
    git = url.rlike(r"^(git\+|git:|git@|ssh:)") | url.rlike(r"\.git(#|\z)") | F.coalesce(F.col("host").rlike(GIT_HOST), F.lit(False))
    pinned = url.rlike(r"(?i)[#/][0-9a-f]{40}(?![0-9a-z_])")
    http = url.startswith("http://")
    shape = (
        F.when(F.col("registry") & url.startswith("https://"), None)
        .when(F.col("host").rlike(HOSTED_FEED), F.struct(F.lit("lockfile-off-registry").alias("id"), F.lit("medium").alias("severity")))
        .when(git, F.struct(F.lit("lockfile-git-dependency").alias("id"), F.when(pinned, "low").otherwise("medium").alias("severity")))
        .when(F.col("host").isin(OFFICIAL_TARBALL_HOSTS) | F.col("host").rlike(INTERNAL_HOST), F.struct(F.lit("lockfile-off-registry").alias("id"), F.lit("medium").alias("severity")))
        .when(http & F.col("registry"), F.struct(F.lit("lockfile-insecure-registry-url").alias("id"), F.lit("low").alias("severity")))
        .otherwise(F.struct(F.lit("lockfile-off-registry").alias("id"), F.lit("high").alias("severity")))
    )
    rows = rows.withColumn("f", shape).filter("f IS NOT NULL").select("repo_id", "file", "line", "name", "resolved", "f.*")
    # Plain http is a fact about the lockfile: one note, the first.
    rank = F.row_number().over(Window.partitionBy("repo_id", "file", "id").orderBy("line", "name", "resolved"))
    return rows.withColumn("rank", rank).filter("id <> 'lockfile-insecure-registry-url' OR rank = 1").drop("rank")


def yarn_entries(lines: DataFrame) -> DataFrame:
    """lines: repo_id, file, line, text of yarn.lock files. Rows (repo_id, file, line, name, resolved): a resolution takes the last header above it."""
    header = F.when(~F.col("text").startswith(" ") & F.col("text").rlike(r'^"?@?[^\s@"]+@'), F.regexp_extract("text", r'^"?(@?[^\s@"]+)@', 1))
    w = Window.partitionBy("repo_id", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("name", F.coalesce(F.last(header, ignorenulls=True).over(w), F.lit("unknown")))
    rows = rows.withColumn("resolved", F.regexp_extract("text", r'^\s+resolved\s+"([^"]+)"', 1))
    return rows.filter("resolved <> ''").select("repo_id", "file", "line", "name", "resolved")


def install_script_findings(packages: DataFrame, declared: DataFrame) -> DataFrame:
    """packages: repo_id, file, name, has_install_script; declared: repo_id, file, name that some entry asks for.

    An install script that nobody asked for is a caution, any other a note; packages known to have one are left out.
    """
    known = F.col("name").isin(INSTALL_SCRIPT_NAMES)
    for p in INSTALL_SCRIPT_PREFIXES:
        known = known | F.col("name").startswith(p)
    asked = declared.select("repo_id", "file", "name").distinct().withColumn("asked", F.lit(True))
    rows = packages.filter("has_install_script").filter(~known).join(asked, ["repo_id", "file", "name"], "left")
    return rows.select("repo_id", "file", "name", F.lit("transitive-install-script").alias("id"), F.when(F.col("asked"), "low").otherwise("medium").alias("severity"))


def manifest_mismatches(git_entries: DataFrame, specs: DataFrame) -> DataFrame:
    """Lockfile entries from git whose manifest in the same directory asks for a registry range."""
    ranges = specs.filter(F.col("spec").rlike(r"^[\^~<>=\s]*v?\d+(\.(\d+|x|\*)){0,2}([-+][\w.]+)?\z"))
    return git_entries.join(ranges.select("repo_id", "dir", "name", "spec"), ["repo_id", "dir", "name"]).select("repo_id", "file", "name", "spec", F.lit("lockfile-manifest-mismatch").alias("id"), F.lit("high").alias("severity"))
