"""Files that something starts by itself, with the findings they must give, written down apart from the patterns."""

import pytest

from sparkwarden.operators.autorun import autorun_findings
from sparkwarden.sources.samples import STARTED as CASES


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(k, p, c) for k, (p, c, _) in enumerate(CASES)], "repo_id int, path string, content string").repartition(4)
    out: dict[int, list] = {}
    for r in autorun_findings(files).collect():
        out.setdefault(r["repo_id"], []).append(r)
    return out


def test_findings(found):
    wrong = [(CASES[k][:2], sorted((r["id"], r["severity"], r["line"]) for r in found.get(k, []))) for k in range(len(CASES)) if sorted((r["id"], r["severity"], r["line"]) for r in found.get(k, [])) != sorted(CASES[k][2])]
    assert not wrong


def test_programs_travel_with_the_finding(found):
    k = next(k for k, c in enumerate(CASES) if c[0] == ".mcp.json")
    assert found[k][0]["programs"] == [".mcp/tools.js"]
