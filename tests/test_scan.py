"""Whole scans of small repositories: what is selected, followed, relaxed and stepped down."""

import json

import pytest

from sparkwarden.plans import scan as plan
from sparkwarden.plans.registry import NOW

C2, CLEAN, DROP = "connect 192.0.2.7:1244", "const a = 1;", "cat k >> ~/.ssh/authorized_keys"
MCP = lambda program: json.dumps({"mcpServers": {"x": {"command": "node", "args": [program]}}})
PKG = lambda **x: json.dumps({"name": "x"} | x)
REPOSITORIES = {
    1: {".mcp.json": MCP("tools/x.js"), "tools/x.js": CLEAN},
    2: {".mcp.json": MCP("tools/x.js"), "tools/x.js": C2},
    3: {".mcp.json": MCP("dist/x.cjs")},
    4: {".mcp.json": MCP("lib/x.cjs")},
    5: {"scripts/deploy.sh": DROP, "README.md": "# x\nNothing to run."},
    6: {"scripts/deploy.sh": DROP, "README.md": "# x\nUse scripts/deploy.sh."},
    7: {"deploy.sh": DROP},
    8: {"package.json": PKG(scripts={"postinstall": "sh bin/setup"}), "bin/setup": C2, "bin/other": C2},
    9: {"package.json": PKG(scripts={"postinstall": "npm run go", "go": "sh tests/go.sh"}), "tests/go.sh": C2, "tests/idle.sh": C2},
    10: {".github/workflows/a.yml": "runs-on: self-hosted", "README.md": "Please register a runner first."},
    11: {".github/workflows/a.yml": "runs-on: self-hosted", "README.md": "Hello"},
    12: {"package.json": PKG(scripts={"postinstall": "node gone.js"})},
    13: {"a/.mcp.json": MCP("./tools/x.js"), "tools/x.js": CLEAN, "a/tools/x.js": C2},
    14: {"package.json": PKG(scripts={"postinstall": " && ".join(f"sh run/{k}" for k in range(25))})} | {f"run/{k}": CLEAN for k in range(25)},
    15: {"scripts/build-all.sh": DROP, "package.json": PKG(scripts={"build": "sh ../x/build-all.sh"})},
    16: {"scripts/build-all.sh": DROP, "package.json": PKG(scripts={"release": "sh ../x/build-all.sh"})},
    17: {"scripts/build-all.sh": DROP, "package.json": PKG(scripts={"release": "sh ../x/build-all.sh"}), "README.md": "npm run release"},
    18: {"package.json": PKG(dependencies={"loadash": "1"}), "x.js": CLEAN},
    19: {"notes.txt": C2},
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(r, k, p, len(c), c) for r, own in REPOSITORIES.items() for k, (p, c) in enumerate(own.items())]
    tree = spark.createDataFrame([x[:4] for x in rows], "repo_id int, ord int, path string, size long")
    files = spark.createDataFrame([(x[0], x[2], x[4]) for x in rows], "repo_id int, path string, content string").repartition(3)
    meta = spark.createDataFrame([], "repo_id int, owner string, repo string, owner_type string, owner_public_repos int, org_public_members int, is_fork boolean, owner_created_at timestamp, commit_authors array<string>, commit_dates array<timestamp>, description string, topics array<string>")
    out = plan.scan(files, tree, meta, NOW)
    return {
        "findings": {(r["repo_id"], r["id"], r["file"]): r["severity"] for r in out.findings.collect()},
        "verdicts": {r["repo_id"]: r["verdict"] for r in out.verdicts.collect()},
        "coverage": {r["repo_id"]: r for r in out.coverage.collect()},
    }


def test_started_programs_are_read_before_they_convict(scanned):
    got = [scanned["findings"][k, "mcp-server-autostart", ".mcp.json"] for k in (1, 2, 3, 4)]
    assert got == ["medium", "high", "medium", "high"]
    assert scanned["findings"][13, "mcp-server-autostart", "a/.mcp.json"] == "high"  # the program beside the file decides


def test_tools_that_nobody_is_told_to_run_step_down(scanned):
    f = scanned["findings"]
    assert [f[k, "ssh-backdoor", "scripts/deploy.sh"] for k in (5, 6)] == ["medium", "high"] and f[7, "ssh-backdoor", "deploy.sh"] == "high"
    assert [f[k, "ssh-backdoor", "scripts/build-all.sh"] for k in (15, 16, 17)] == ["high", "medium", "high"]


def test_files_that_an_install_runs_are_code(scanned):
    f = scanned["findings"]
    assert f[8, "c2-port-fingerprint", "bin/setup"] == "high" and (8, "c2-port-fingerprint", "bin/other") not in f
    assert f[9, "c2-port-fingerprint", "tests/go.sh"] == "high" and f[9, "c2-port-fingerprint", "tests/idle.sh"] == "medium"
    assert (19, "c2-port-fingerprint", "notes.txt") not in f


def test_runner_is_a_caution_where_the_readme_asks_for_one(scanned):
    assert [scanned["findings"][k, "workflow-self-hosted-runner", ".github/workflows/a.yml"] for k in (10, 11)] == ["medium", "low"]


def test_coverage_tells_what_was_left_out(scanned):
    c = scanned["coverage"]
    assert (c[12]["unresolved"], c[12]["dropped"], c[12]["files"]) == (1, 0, 1)
    assert (c[14]["unresolved"], c[14]["dropped"], c[14]["files"]) == (0, 5, 21)
    assert c[8]["files"] == 2 and c[8]["chars"] == len(C2) + len(REPOSITORIES[8]["package.json"])


def test_verdicts(scanned):
    v = scanned["verdicts"]
    assert {k: v[k] for k in (1, 2, 3, 4, 5, 8, 12, 18, 19)} == {1: "yellow", 2: "red", 3: "yellow", 4: "red", 5: "yellow", 8: "red", 12: "green", 18: "red", 19: "green"}
