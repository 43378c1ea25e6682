"""package.json: scripts, dependencies, overrides and commands, read as a VARIANT; and the files its scripts run.

All rules but those on names read one row a manifest with array functions, so nothing is exploded before it is a finding.
A script that a hook runs by name is expanded in place, as often as there are scripts to expand. Nested overrides are
opened level by level. A manifest with two equal keys in an object counts as unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.text import directory, let, line_of_text
from sparkwarden.operators.dependencies import POPULAR, name_findings
from sparkwarden.operators.shell import dangerous_script

MANIFEST = r"(^|/)package\.json\z"
# Scripts that an install runs, in the order in which it does; names that people run; fields with dependencies.
HOOKS = ["preinstall", "install", "postinstall", "prepublish", "preprepare", "prepare", "postprepare", "prepack", "postpack"]
EVERYDAY = r"(?i)^(start|dev|serve|test|build|watch|preview|setup|bootstrap|init|install|seed|migrate|demo|app|main|run)(:|\z)"
RUNS_SCRIPT = r"\b(?:npm|pnpm|yarn|bun)\s+run(?:-script)?\s+(?:-\S{1,60}\s+)*([\w:@./-]+)"
FIELDS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
SHADOWED = ["npm", "npx", "node", "yarn", "pnpm", "git", "python", "python3", "pip", "pip3", "code", "bash", "sh", "sudo", "make", "cargo", "go"]
SURVEILLANCE = [
    "node-global-key-listener", "iohook", "gkm", "node-key-sender", "screenshot-desktop", "screenshot", "desktop-screenshot", "active-win", "node-window-manager", "get-windows", "robotjs", "@nut-tree/nut-js", "nut-js",
    "@jitsi/robotjs", "keysender", "node-webcam", "node-record-lpcm16",
]
FRONTEND, SERVER = ["react", "vue", "next", "svelte", "vite"], ["express", "socket.io", "ws", "koa", "fastify", "request"]
KNOWN_GIT_SOURCES = ["foundry-rs/forge-std"]
GIT_SOURCE = r"(?i)(?:github\.com[/:]|^github:|^)([\w.-]+/[\w.-]+?)(?:\.git)?(?:[#@].*)?\z"
OWN_PATH, OFF_REGISTRY, REDIRECT = r"(?i)^(file|link|workspace|portal):", r"^(git\+|git:|git@|github:|bitbucket:|gitlab:|https?:)", r"^(git\+|git:|git@|github:|https?:|file:)"
PINNED = r"(?i)#[0-9a-f]{40}\z|/[0-9a-f]{40}(?:\.(?:tar\.gz|tgz|zip))?\z|#(?:semver:)?v?\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?\z"
REGISTRY_SPEC = r"^(\s*\z|[\^~=<>]|\d|\*|x\z|latest\z|next\z)"
SCRIPT_FILE = r"(?:^|[\s;&|(])(?:node|ts-node|tsx|python3?|sh|bash|zsh|ruby|perl|php)\s+(?:-\S{1,60}\s+)*(\.{0,2}/?[\w./-]+)|(?:^|[\s;&|(])(\./[\w./-]+)"
#: Levels of nested overrides that are opened, and scripts that a hook is expanded by; past these all scripts are read as one.
DEPTH, EXPANDED = 100, 200

_ENTRY, _FINDING = "struct<name:string,spec:string>", "struct<id:string,severity:string,line:int>"


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_of(value: Column) -> Column:
    """A string as it is, anything else as its JSON text."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def object_of(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def entries_of(value: Column, path: str = "$") -> Column:
    """Entries of an object, none if it is no object."""
    return F.coalesce(F.map_entries(object_of(value, path)), F.array().cast("array<struct<key:string,value:variant>>"))


def known_git_source(spec: Column) -> Column:
    return F.lower(F.regexp_extract(spec, GIT_SOURCE, 1)).isin(KNOWN_GIT_SOURCES)


def _finding(id_: str, severity: Column | str, line: Column) -> Column:
    return F.struct(F.lit(id_).alias("id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), line.cast("int").alias("line"))


def expanded(command: Column, scripts: Column) -> Column:
    """A command with every `npm run x` replaced by script x, each once, the first first. scripts: map of names to commands."""
    name = lambda m: F.regexp_extract(m, RUNS_SCRIPT, 1)

    def step(a: Column, _: Column) -> Column:
        open_ = F.filter(F.regexp_extract_all(a["text"], F.lit(RUNS_SCRIPT), F.lit(0)), lambda m: let(name(m), lambda n: F.map_contains_key(scripts, n) & ~F.array_contains(a["seen"], n)))

        def put(m: Column) -> Column:
            at = F.instr(a["text"], m)
            return F.struct(F.overlay(a["text"], F.element_at(scripts, name(m)), at, F.length(m)).alias("text"), F.array_append(a["seen"], name(m)).alias("seen"))

        return let(F.get(open_, F.lit(0)), lambda m: F.when(m.isNotNull(), put(m)).otherwise(a))

    zero = F.struct(command.alias("text"), F.array().cast("array<string>").alias("seen"))
    done = F.aggregate(F.sequence(F.lit(1), F.least(F.size(scripts), F.lit(EXPANDED))), zero, step, lambda a: a["text"])
    rest = F.when(F.size(scripts) > EXPANDED, F.concat(done, F.lit(" ; "), F.array_join(F.map_values(scripts), " ; "))).otherwise(done)
    return F.when(command.rlike(RUNS_SCRIPT) & (F.size(scripts) > 0), rest).otherwise(command)


def flattened(value: Column, path: str) -> Column:
    """Leaves (name, spec) of nested objects and arrays; the names of a leaf's parents stand before it. Other leaves than strings are left out."""
    zero = F.struct(F.transform(entries_of(value, path), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("nodes"), F.array().cast(f"array<{_ENTRY}>").alias("leaves"))

    def below(n: Column) -> Column:
        items = F.coalesce(F.try_variant_get(n["value"], "$", "array<variant>"), F.array().cast("array<variant>"))
        own = F.transform(entries_of(n["value"]), lambda e: F.struct(F.concat(n["name"], F.lit(" > "), e["key"]).alias("name"), e["value"].alias("value")))
        return F.concat(own, F.transform(items, lambda v, i: F.struct(F.concat(n["name"], F.lit(" > "), i.cast("string")).alias("name"), v.alias("value"))))

    def step(a: Column, _: Column) -> Column:
        leaves = F.transform(F.filter(a["nodes"], lambda n: is_string(n["value"])), lambda n: F.struct(n["name"].alias("name"), string_of(n["value"]).alias("spec")))
        return F.when(F.size(a["nodes"]) > 0, F.struct(F.flatten(F.transform(a["nodes"], below)).alias("nodes"), F.concat(a["leaves"], leaves).alias("leaves"))).otherwise(a)

    return F.when(object_of(value, path).isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), zero, step, lambda a: a["leaves"])).otherwise(F.array().cast(f"array<{_ENTRY}>"))


def _outside(entries: Column, table: Column) -> Column:
    return F.filter(entries, lambda e: ~F.map_contains_key(table, e["key"]))


def manifests(files: DataFrame) -> DataFrame:
    """Manifests with `pkg`, the parsed text; `scripts`, a map of names to commands; and `deps`, (name, spec) of the last field that has the name."""
    rows = files.filter(F.col("path").rlike(MANIFEST) & F.col("content").isNotNull()).withColumn("pkg", F.try_parse_json("content"))
    scripts = F.filter(entries_of(F.col("pkg"), "$.scripts"), lambda e: is_string(e["value"]))
    rows = rows.withColumn("scripts", F.map_from_entries(F.transform(scripts, lambda e: F.struct(e["key"], string_of(e["value"])))))
    tables = [F.coalesce(object_of(F.col("pkg"), f"$.{f}"), F.create_map().cast("map<string,variant>")) for f in FIELDS]
    own = []
    for k, t in enumerate(tables):
        kept = F.map_entries(t)
        for later in tables[k + 1 :]:
            kept = _outside(kept, later)
        own.append(F.transform(kept, lambda e: F.struct(e["key"].alias("name"), string_of(e["value"]).alias("spec"))))
    return rows.withColumn("deps", F.concat(*own))


def specs(files: DataFrame) -> DataFrame:
    """Rows (repo_id, dir, name, spec) of the manifests' direct dependencies."""
    return manifests(files).select("repo_id", directory(F.col("path")).alias("dir"), F.explode("deps").alias("d")).select("repo_id", "dir", "d.name", "d.spec")


def manifest_findings(files: DataFrame, popular: list[str] = POPULAR) -> DataFrame:
    """files: repo_id, path, content. Rows (repo_id, id, severity, file, line); popular: much used names, which imitations resemble."""
    rows = manifests(files)
    pkg, content, scripts, deps = (F.col(c) for c in ("pkg", "content", "scripts", "deps"))
    at = lambda key: line_of_text(content, F.concat(F.lit('"'), key, F.lit('"')))
    none = F.array().cast(f"array<{_FINDING}>")
    broken = ~F.coalesce(F.schema_of_variant(pkg).rlike("^(OBJECT|ARRAY)"), F.lit(False))

    hooks = F.filter(F.array(*(F.lit(h) for h in HOOKS)), lambda h: F.map_contains_key(scripts, h))
    hooked = F.transform(hooks, lambda h: _finding("lifecycle-script", F.when(dangerous_script(expanded(F.element_at(scripts, h), scripts)), "high").otherwise("low"), at(h)))
    others = F.filter(F.map_entries(scripts), lambda e: ~e["key"].isin(HOOKS) & dangerous_script(e["value"]))
    scripted = F.transform(others, lambda e: _finding("dangerous-npm-script", F.when(e["key"].rlike(EVERYDAY), "medium").otherwise("low"), at(e["key"])))

    watching = F.transform(F.filter(deps, lambda d: F.lower(d["name"]).isin(SURVEILLANCE)), lambda d: _finding("surveillance-dependency", "medium", at(d["name"])))

    def alias(d: Column) -> Column:
        name, target = F.lower(d["name"]), F.regexp_extract(d["spec"], r"(?i)^npm:(@[^/]+/[^@]+|[^@]+)", 1)
        low, base = F.lower(target), F.regexp_extract(F.lower(target), "^@[^/]*/(.*)$", 1)
        fork = low.endswith(F.concat(F.lit("-"), name)) & F.substring(low, F.lit(1), F.length(low) - F.length(name) - 1).rlike(r"(^|/)[\w.]+\z")
        shown = fork | ((base != "") & ((base == name) | base.startswith(F.concat(name, F.lit("-"))))) | low.isin(popular)
        disguised = (target != "") & (low != name) & ~low.startswith(F.concat(F.lit("@"), name, F.lit("/"))) & name.isin(popular)
        return F.when(disguised, _finding("npm-alias-mismatch", F.when(shown, "medium").otherwise("high"), at(d["name"])))

    aliased = F.array_compact(F.transform(F.filter(deps, lambda d: d["spec"].rlike("(?i)^npm:")), alias))
    foreign = F.transform(F.filter(deps, lambda d: d["spec"].rlike(OFF_REGISTRY)), lambda d: _finding("manifest-non-registry-dependency", F.when(known_git_source(d["spec"]) | d["spec"].rlike(PINNED), "low").otherwise("medium"), at(d["name"])))

    def redirects(field: str) -> Column:
        return F.transform(F.filter(flattened(pkg, f"$.{field}"), lambda e: e["spec"].rlike(REDIRECT)), lambda e: _finding("override-redirect", "medium", at(F.lit(field))))

    redirected = [redirects("overrides"), redirects("resolutions")]

    own_name = F.lower(F.coalesce(F.try_variant_get(pkg, "$.name", "string"), F.lit("")))
    bin_ = F.try_variant_get(pkg, "$.bin", "variant")
    commands = F.when(is_string(bin_), F.array(own_name)).otherwise(F.transform(entries_of(bin_), lambda e: F.lower(e["key"])))
    shadowed = F.transform(F.filter(commands, lambda c: c.isin(SHADOWED) & ~own_name.isin(SHADOWED)), lambda c: _finding("bin-command-shadowing", "high", at(F.lit("bin"))))

    native = F.coalesce(F.try_variant_get(pkg, "$.gypfile", "boolean"), F.lit(False)) & (F.schema_of_variant(F.try_variant_get(pkg, "$.gypfile", "variant")) == "BOOLEAN")
    served = F.size(F.filter(deps, lambda d: d["name"].isin(SERVER))) >= 2
    odd = F.exists(deps, lambda d: d["name"].isin(FRONTEND)) & served
    singles = F.array_compact(F.array(
        F.when(broken, _finding("broken-package-json", "low", F.lit(None))),
        F.when(native, _finding("native-build-at-install", "medium", at(F.lit("gypfile")))),
        F.when(odd, _finding("odd-dependency-mix", "medium", F.lit(None))),
    ))
    every = F.concat(*(F.coalesce(x, none) for x in (singles, hooked, scripted, watching, aliased, foreign, *redirected, shadowed)))
    found = rows.select("repo_id", F.col("path").alias("file"), F.explode(every).alias("f")).select("repo_id", "f.id", "f.severity", "file", "f.line")
    named = rows.select("repo_id", F.col("path").alias("file"), F.explode(F.filter("deps", lambda d: ~d["spec"].rlike(OWN_PATH))).alias("d")).select("repo_id", "file", "d.name")
    names = name_findings(named, popular=popular).select("repo_id", "id", "severity", "file", F.lit(None).cast("int").alias("line"))
    return found.unionByName(names)


def script_references(files: DataFrame) -> DataFrame:
    """Rows (repo_id, from_path, rel): files that install hooks run, indirectly too, and targets of `bin`; none leaves the repository."""
    rows = manifests(files)
    scripts, pkg = F.col("scripts"), F.col("pkg")
    bodies = F.transform(F.filter(F.array(*(F.lit(h) for h in HOOKS)), lambda h: F.map_contains_key(scripts, h)), lambda h: expanded(F.element_at(scripts, h), scripts))
    run = F.flatten(F.transform(bodies, lambda b: F.zip_with(F.regexp_extract_all(b, F.lit(SCRIPT_FILE), F.lit(1)), F.regexp_extract_all(b, F.lit(SCRIPT_FILE), F.lit(2)), lambda x, y: F.when(x != "", x).otherwise(y))))
    inside = F.filter(F.transform(run, lambda p: F.regexp_replace(p, r"^\./", "")), lambda p: (p != "") & ~p.startswith("/") & ~p.contains(".."))
    bin_ = F.try_variant_get(pkg, "$.bin", "variant")
    targets = F.when(is_string(bin_), F.array(string_of(bin_))).otherwise(F.transform(F.filter(entries_of(bin_), lambda e: is_string(e["value"])), lambda e: string_of(e["value"])))
    every = F.array_distinct(F.concat(inside, F.coalesce(F.transform(targets, lambda p: F.regexp_replace(p, r"^\./", "")), F.array().cast("array<string>"))))
    return rows.select("repo_id", F.col("path").alias("from_path"), F.explode(every).alias("rel"))
