"""Each operator against a plain version on rows with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import byte_dedup, decontamination, html_text, jaccard_join, lm_scoring, packing, quality_rules, sharding, substring_dedup, warc_index
from sparkwarden.llm.components import components
from sparkwarden.llm.shared import IdFilter

WORD = "[^\x20\x09-\x0d]+"
KIND = "doc_id long, text string, n_words long, bucket string, _id string"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(x):
    return re.findall(WORD, x or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(400)] + ["Été", "ÉTÉ", "日本語", "a#b", "x|y", "The", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, passage), (5, say(30) + "\n" + passage + " " + say(20)), (6, passage), (7, base)]
    near = base.split(" ")
    for k in range(8, 13):
        near = list(near)
        near[k * 7] = "changed%d" % k
        out.append((k, " ".join(near)))
    out += [(13, "spam " * 300), (14, say(3000) + " " + passage), (15, base), (15, base), (16, "a b c d"), (17, "a b c d"), (18, "A B c d"), (None, base), (None, None)]
    out += [(20 + k, say(rng.randrange(1, 90))) for k in range(25)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "b", "c") for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_id_filter_has_no_false_negatives(spark, docs):
    some = docs.filter("doc_id % 3 = 0").select("doc_id")
    got = IdFilter(some, "doc_id").mark(docs, "doc_id", "held").select("doc_id", "held").collect()
    assert all(r["held"] for r in got if r["doc_id"] is not None and r["doc_id"] % 3 == 0)
    assert not any(r["held"] for r in got if r["doc_id"] is None) and not all(r["held"] for r in got)


def test_substring_dedup(docs, none, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    out = substring_dedup.remove_repeated_windows(docs)
    assert out.columns == ["doc_id", "text", "bucket", "_id", "n_words", "n_removed", "kept_text"]
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def test_byte_dedup(docs, none, rows):
    known = sorted({(i, zlib.crc32((t or "").encode()), (t or "")) for i, t in rows if i is not None})
    seen, cover = set(), {}
    for i, tag, t in known:
        b = t.encode()
        gone = set()
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone.update(range(k, k + 100))
            seen.add(s)
        cover[i, tag] = gone
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = cover.get((i, zlib.crc32(b)), set())
        spans = sum(j - 1 not in gone for j in gone)
        want.append((str(i), len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone)))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in byte_dedup.remove_repeated_bytes(docs, keep=["doc_id"]).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert byte_dedup.remove_repeated_bytes(none).count() == 0


def test_decontamination(spark, docs, none, rows):
    item = " ".join(words(rows[5][1])[33:60])
    benchmark = [(1, item.upper()), (2, "one"), (3, None), (None, "a b c d"), (4, "a, B! c d"), (4, "nothing of it at all"), (10, "w1 " * 12)]
    kind = "item_id long, text string, doc_id long"
    found = decontamination.contamination(docs, spark.createDataFrame([(i, t, 0) for i, t in benchmark], kind)).collect()
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    want = []
    for i, t in rows:
        w, hit, items = word(t), set(), set()
        for item_id, q in benchmark:
            q = word(q)
            k = min(10, len(q))
            if item_id is not None and k:
                for a in range(len(q) - k + 1):
                    for b in range(len(w) - k + 1):
                        if w[b : b + k] == q[a : a + k]:
                            hit.update(range(b, b + k))
                            items.add(str(item_id))
        want.append((str(i), len(w), len(hit), ",".join(sorted(items))))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found]
    assert sorted(got) == sorted(want) and sum(bool(x[2]) for x in want) > 3
    empty = spark.createDataFrame([], kind)
    assert decontamination.contamination(docs, empty).filter("contaminated").count() == 0 and decontamination.contamination(none, empty).count() == 0


def test_decontamination_in_blocks_equals_one(spark, docs, rows, monkeypatch):
    benchmark = spark.createDataFrame([(k, t[:200]) for k, (i, t) in enumerate(rows) if t and k % 3 == 0], "item_id long, text string")
    show = lambda df: sorted(df.select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", F.array_join("items", ",")).collect())
    one = show(decontamination.contamination(docs, benchmark))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 700)
    assert show(decontamination.contamination(docs, benchmark)) == one


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "b a"), (3, "a x x x x x b")], "doc_id long, text string")
    got = decontamination.near(decontamination.build_index(docs), [("ab", "a b"), ("abc", "c a b")], 5).collect()
    assert sorted((r["doc_id"], r["query"], r["position"]) for r in got) == [(1, "ab", 0), (2, "ab", 0)]


def _groups(rows):
    sets = []
    for i, t in rows:
        w = words(lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(str(i), len(sets[k]), str(least[root(k)] if i is not None else None)) for k, (i, _) in enumerate(rows)]


def test_jaccard_groups(docs, none, rows):
    got = [(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.similar_documents(docs).collect()]
    assert sorted(got) == sorted(_groups(rows))
    assert jaccard_join.similar_documents(none).count() == 0


@pytest.mark.parametrize("costly,seed", [(2000, 4), (2, 6)])
def test_class_links_lose_none(spark, costly, seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(14):
        base = [rng.getrandbits(60) for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        own = [rng.getrandbits(60) for _ in range(6)]  # few enough that copies share what they add
        for _ in range(rng.randint(1, 25)):
            x = set(base)
            for _ in range(rng.randint(0, max(1, len(base) // 4))):
                x.discard(rng.choice(base))
                if rng.random() < 0.6:
                    x.add(rng.choice(own) if rng.random() < 0.5 else rng.getrandbits(60))
            if x:
                sets.append(frozenset(x))
    sets = list(dict.fromkeys(sets))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, len(x), sorted(x)) for i, x in enumerate(sets)], "c long, size long, elements array<long>")
    of = {r["node"]: r["component"] for r in components(jaccard_join.class_links(df, 75, costly)).collect()}
    want = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert of == want


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 95: 90, 90: 90}


def test_quality_statistics(docs, none, rows):
    got = quality_rules.judged(docs, []).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        own = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(own)
        covered = {j for k, x in enumerate(own) if many[x] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((str(i), len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not failed))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == sorted(want)
    assert quality_rules.judged(none, []).count() == 0


def test_decision_list_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.learn(quality_rules.labelled(docs, labels.filter("doc_id % 2 = 0")))
    assert rules and all(str(c) for r in rules for c in r)
    seen = quality_rules.judged(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), rules).filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in seen.groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))
    assert quality_rules.learn(quality_rules.labelled(docs, labels.filter("quality = 1"))) == []


def test_lm_scores(docs, none, rows):
    out = lm_scoring.score(docs).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update([*words(lower(t or "")), None])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = [*words(lower(t or "")), None]
        want.append((str(i), held(i), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == sorted(want)
    assert all(r["score"] <= 0 for r in out)
    assert lm_scoring.score(none).count() == 0


def test_log_frequency_filter_never_forgets():
    import numpy as np

    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 4001)
    lev = lm_scoring.level(counts)
    bits = lm_scoring.slice_bits(keys & lm_scoring.LOW, lev, np.zeros(len(keys), int), 64 * (10 * int(lev.sum()) // 64 + 1))
    model = lm_scoring.LogFrequencyFilter({0: bits.tobytes()}, 1)
    assert (model.levels(keys, 0) >= lev).all() and (model.levels(keys, 0) == lev).mean() > 0.95
    assert (model.levels(keys ^ np.uint64(1), 0) == 0).mean() > 0.95


def test_packing(spark, docs, none, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = [(900, "Naïve ÉCOLE Ünïcode ﬁ ½ don't STOP... 日本語 áb  x <|endoftext|> <|EndOfText|> İ Σας it's. ªº", 1, "", "")]
    own = docs.unionByName(spark.createDataFrame(odd, KIND))
    got = packing.pack(own, path, keep_ids=True)
    pieces = got.collect()
    want = []
    for i, t in [*rows, (900, odd[0][1])]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(i), k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(want)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_pieces in by.values():
        end = 0
        for at, n in sorted(own_pieces):
            assert at == end
            end += n
        assert end <= 2048
    assert len(by) <= 1 + -(-sum(r["length"] for r in pieces) // 2048)
    assert packing.sequences(got).count() == len(by) and packing.pack(none, path).count() == 0


def test_packing_plan_places_every_piece_once():
    rng = random.Random(2)
    for n in (1, 7, 900):
        lengths = [min(2048, max(1, int(rng.lognormvariate(5.5, 1.3)))) for _ in range(n)]
        layout, sequences = packing.plan(Counter(lengths))
        assert sum(r[2] - r[1] for r in layout.tolist()) == n and sequences <= len(lengths)
        fill = Counter()
        for length, a, b, s, m, _ in layout.tolist():
            assert b - a == m
            for k in range(m):
                fill[s + k] += length
        assert len(fill) == sequences and max(fill.values()) <= 2048


def test_sharding(docs, none, rows):
    got = sharding.shard(docs, shards=4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    of = {}
    for r in got:
        of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in of.values())
    assert sharding.shard(none).count() == 0


def test_differencing_beats_greedy():
    rng = random.Random(8)
    weights = [rng.randrange(1, 1000) for _ in range(60)]
    sums, place = sharding.difference([[w, 0, 0, 0] for w in weights])
    own = [0] * 4
    for w, p in zip(weights, place[:, 0], strict=True):
        own[p] += w
    greedy = [0] * 4
    for w in sorted(weights, reverse=True):
        greedy[greedy.index(min(greedy))] += w
    assert own == list(sums) and max(own) - min(own) <= max(greedy) - min(greedy)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    pages = [(1, "http://www.B.example/x?q=1#f", big, 5), (2, "https://b.example/x?q=1", big, 5), (9, None, big, 5), (3, "http://a.example", "small", 5), (4, "http://a.example", "small", 5), (5, "http://a.example/\n", None, 5), (6, "", "", 5), (None, "http://c.example", "x\0y", 5), (2, "https://b.example/x?q=1", big, 5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_bytes int").repartition(3)
    warc_index.write_archives(df, str(tmp_path / "w"))
    captures = warc_index.read_archives(spark, str(tmp_path / "w")).withColumn("seq", F.monotonically_increasing_id()).cache()
    got = captures.join(warc_index.merged_index(captures).drop("captured"), "seq").collect()
    want = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and i != 9
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    order = sorted(got, key=lambda r: r["index_place"])
    assert [r["index_place"] for r in order] == list(range(len(pages)))
    keys = [(r["url_key"], r["captured"]) for r in order]
    assert keys == sorted(keys) and "example,b)/x?q=1" in {k for k, _ in keys}
    none = df.limit(0)
    warc_index.write_archives(none, str(tmp_path / "e"))
    assert warc_index.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_loser_tree_merges():
    import heapq

    for k in range(8):
        rng = random.Random(k)
        runs = [sorted(rng.choices(range(40), k=rng.randrange(12))) for _ in range(k)]
        assert list(warc_index.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("a <b>b</b>c", "a bc"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>a<li>b<ol start=4><li>c</ol></ul>", "- a\n- b\n  4. c"),
        ("<table><tr><th>x<td>long cell<tr><td>yy<td>z</table>", "x   long cell\nyy  z"),
        ("<style>a</style>b<script>if (a<b) {}</script><p hidden>c</p><p style='display: none'>d</p>&amp;&lt;", "b&<"),
        ("<pre>\n a\n  b </pre>c", " a\n  b\n\nc"),
        ("x<br>y<!-- c -->z < 1 <", "x\nyz < 1 <"),
        ("a<p title='never closed", "a"),
        ("</div></p>a", "a"),
        ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_page_text(page, text):
    assert html_text.page_text(page)[0] == text


def test_pages_keep_their_rows(spark):
    rows = [(1, "<p>a", 1), (1, "<p>a", 2), (2, None, 3), (None, "<b>x", 4), (3, "<div>" * 3000 + "deep", 5), (4, "x" * 300_000, 6)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == sorted([("1", 1), ("1", 1), ("2", 0), ("None", 1), ("3", 4), ("4", 300_000)])


@pytest.mark.parametrize("frequent", [1 << 18, 4])
def test_lm_scores_use_every_pair(spark, docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    import numpy as np

    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *words(lower(t or "")), None]
            one.update(w)
            two.update(zip(w[:-1], w[1:], strict=True))
    n, v = sum(one.values()) - one["<s>"], len(one) - 1
    size = lambda c: float(lm_scoring.value(lm_scoring.level(np.array([c])))[0]) if c else 0.0
    want = {}
    for i, t in rows:
        w = ["<s>", *words(lower(t or "")), None]
        p = [0.2 * (min(1.0, size(two[a, b]) / size(one[a])) if one[a] else 0.0) + 0.8 * (size(one[b]) + 0.1) / (n + 0.1 * (v + 1)) for a, b in zip(w[:-1], w[1:], strict=True)]
        want.setdefault((i, len(p)), sum(map(math.log10, p)))
    got = lm_scoring.score(docs).collect()
    off = [abs(r["score"] - want[r["doc_id"], r["n_tokens"]]) / r["n_tokens"] for r in got]
    # The filter may take an n-gram for a more frequent one, in about one of a hundred.
    assert len(got) == len(rows) and max(off) < 0.1 and sum(off) / len(off) < 0.02


def test_lm_scores_name_a_block_not_each_text_in_each_partition(spark, docs):
    from types import SimpleNamespace

    n = 64
    model = lm_scoring.LogFrequencyFilter({}, n), lm_scoring.Frequent([], n), lm_scoring.Frequent([], n)
    kind = lm_scoring.packed.schema(["t", "c", "k"], 1)
    asked = docs.selectExpr("doc_id AS _id", "text AS _text").mapInArrow(lm_scoring._asked(SimpleNamespace(value=model), n, 1.0), kind)
    r = asked.filter("kind = 3").selectExpr("sum(length(ids) + length(tags) + length(counts)) AS names", "sum(length(h0)) AS pairs").first()
    assert 0 < r["names"] < r["pairs"] / 4


def test_byte_dedup_shuffles_only_positions_to_the_texts_it_stored(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(byte_dedup.remove_repeated_bytes(docs, keep=["doc_id"])._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan, re.M)
    assert moved and not [x for x in moved if "_text#" in x]


@pytest.mark.parametrize("parts", [1, 4])
def test_byte_dedup_keeps_the_first_holder_of_a_repeated_row(spark, parts):
    rng = random.Random(parts)
    say = lambda n: " ".join("w%d" % rng.randrange(900) for _ in range(n))
    base, other = say(90), say(60)
    rows = [(1, base), (1, base), (2, "before " + base), (3, other), (3, other), (3, other), (4, other[:150] + say(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r["doc_id"], bytes(r["kept_bytes"]).decode()) for r in byte_dedup.remove_repeated_bytes(df).collect())
    want = sorted([*rows[:2], (2, "before "), *rows[3:6], (4, rows[6][1][150:])])
    assert got == want


@pytest.mark.parametrize(
    "page,text",
    [
        ("<!doctype html><head><title>T</title><p>text", "text"),
        ("<html><head> <meta charset=utf-8><style>x</style>\n plain", "plain"),
        ("<head><title>T</title></head>a", "a"),
        ("<head><noscript><p>x</noscript><script>y</script><body>a", "a"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tbody><th>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><caption>t<tr><td>a</table>", "t\na"),
        ("<table>x<tbody>y<tr>z<td>a</table>b", "xyz\n\na\n\nb"),
        ("<table><tr><div>x</div><td>a<div>b</div></table>", "x\n\na b"),
        ("<table><form><tr><td>a</form></table>", "a"),
        ("<table><tr><td>a<table>x<td>b</table><td>c</table>", "ax b  c"),
        ("<table><td>a<tr><table><td>b</table>", "a\n\nb"),
        ("a<xmp><b>&amp;\n c</xmp>d", "a\n\n<b>&amp;\n c\n\nd"),
    ],
)
def test_page_text_of_implied_parts(page, text):
    assert html_text.page_text(page)[0] == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<a title=don't>b</a> c", "b c"),
        ("<a href=/o'reilly>b</a> c <i title='x'>d</i>", "b c d"),
        ("<p class=\"a\"\">b<p class=\"c\">d", "b\n\nd"),
        ("<p title='a > b'>c", "c"),
        ("<p title = \"a > b\" hidden>c</p>d", "d"),
        ("<p =\"a>b", "b"),
        ("<p title=>b", "b"),
        ("<p a=b\"hidden\">c</p 'x>d", "c\n\nd"),
        ("<br/>a<img src=x/>b<p/class='x'hidden>c", "ab"),
    ],
)
def test_page_text_with_stray_quotes(page, text):
    assert html_text.page_text(page)[0] == text


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_warc_of_large_ids_in_any_time_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(1, "http://a.example/x", "p"), (10**18, "http://a.example/y", "q"), (-5, None, None), (None, "http://b.example/", "r")]
        warc_index.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "archives"))
        got = {r["page_id"]: r["captured"] for r in warc_index.read_archives(spark, str(tmp_path / "archives")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: warc_index.EPOCH + (i or 0) % warc_index.SPAN for i, _, _ in rows}


def test_runs_in_a_scratch_file_merge_in_order():
    rng = random.Random(2)
    runs = warc_index.Runs()
    all_ = []
    for n in (0, 1, 700, 257, 256):
        own = sorted((rng.randrange(50), k) for k in range(n))
        all_ += own
        runs.add(own)
    assert [x[0] for x in warc_index.LoserTree([runs.read(k) for k in range(5)])] == sorted(x[0] for x in all_)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>x</title><p>Hello", "Hello"),
        ("a<table>loose<tr><td>c</td>loose2</tr></table>d", "alooseloose2\n\nc\n\nd"),
        ("<table><div>q</div><tr><td>z</table>", "q\n\nz"),
        ("<xmp>shown</xmp>", "shown"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<div>" * 3000 + "<p style='display:none'>no</p>yes", "yes"),
        ("<a title=don't>x</a> y", "x y"),
    ],
)
def test_html_shapes(page, text):
    assert html_text.page_text(page)[0].strip() == text


def test_html_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
