"""Operators 11 to 13 against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from sparkwarden.llm import bpe_encoding, importance, spelling
from sparkwarden.llm.shared import Tables

KIND = "doc_id long, text string, n bigint, word string, ids string, _id string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, 7, "b", "c", "d") for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


TEXTS = [None, "", " ", "\n\n  a", "don't  we'll\tgo 12³ ½x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "日本語 テキスト、123", "é x y\u0085z", "🙂🙂 ok", "_a__b  \r\n\r\n", "word " * 50, "x" * 3000, "'s'S'LL ''ll", "Ünïcödé ªº µ ×÷", "\x00\x01 \x7f"]


def library(bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("words", [4, 1 << 18])
def test_bpe_equals_the_library(spark, bpe, words):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "Été", "naïve", "12", "—", "語", "\t", "it's"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts.append(" ".join("w%d" % (k % 5000) for k in range(120_000)))
    rows = [(i % 45 or None, t) for i, t in enumerate(texts)]
    lib = library(bpe)
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = bpe_encoding.digests(bpe_encoding.encode(made(spark, rows), bpe, block_words=words), bpe)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_bpe_decodes_any_ids(spark, bpe):
    rng = random.Random(4)
    lists = [[], [50256], [0, 1, 2], *([rng.randrange(50257) for _ in range(30)] for _ in range(20))]
    pack = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    table = spark.createDataFrame([(k, pack(x)) for k, x in enumerate(lists)] + [(99, None), (98, pack([5, 60000]))], "k int, ids binary")
    got = {r["k"]: r["text"] for r in bpe_encoding.decode(table, bpe).collect()}
    lib = library(bpe)
    assert got == {k: lib.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {99: "", 98: lib.decode([5])}


def test_bpe_splits_as_the_library_does(bpe):
    lib, own = library(bpe), bpe_encoding.Tokenizer(open(bpe, encoding="utf-8").read())
    for lo in range(0, 0x110000, 0x1000):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000)
        if lo == 0:
            text += "".join(f"{chr(a)}{chr(b)} " for a in range(256) for b in range(0, 256, 7))
        want = [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)] if text else []
        assert own.words(text) == want, hex(lo)
        settled = "".join(c for c in text if bpe_encoding._settled.fullmatch(c))
        assert own.words(settled) == [settled[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(settled)], hex(lo)
    latin = "".join(f"{chr(a)}{chr(b)} {chr(a)}" for a in range(256) for b in range(256))
    assert bpe_encoding._latin.findall(latin) == regex.findall(bpe_encoding.PATTERN, latin)


def test_bpe_refuses_other_definitions(bpe):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe_encoding.Tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(counts):
    words = sorted(counts)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    found = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)] for w in words}
    best = {w: min(x, key=lambda v: (-counts[v], v)) if x else None for w, x in found.items()}
    form = {w: b if b and counts[b] >= 10 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(found[w]), counts[form[w]] if form[w] else None) for w in words)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("most", [2, 64])
def test_spelling_equals_brute_force(spark, most):
    rng = random.Random(7)
    rows = []
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 13))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 90, "Größe×÷ähn"]
    for i in range(120):
        said = []
        for _ in range(40):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "q", "a", "Ä", w[k] + "b"]) + w[k + 1 :]
            said.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(said) + rng.choice([".", " 日本語", ""])))
    rows += [(200, None), (201, ""), (None, "aaaaaaa aaaaaaa bbbbbbbbb"), (202, "aaaaaaa1aaaaaaa"), (203, "".join(rng.choice("ab") for _ in range(5000))), (203, rows[0][1]), (203, rows[0][1])]
    rows.append((300, "chainab " * 600 + "chainabq " * 40 + "chainabqq " * 3))
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    want = plain_spelling({w: n for w, n in counts.items() if n >= 2})
    got = sorted(tuple(r) for r in spelling.variant_groups(made(spark, rows), most_entries=most).select(COLUMNS).collect())
    assert got == want
    assert len(got) > 300 and any(f for _, f, *_ in got) and any(r != f for _, f, r, *_ in got if f)


def test_near_words_of_many_copies_of_a_half(spark):
    """A third of all words share their first half, and another third the last; chains of forms; very long and short words."""
    rng = random.Random(8)
    letters = "abcdefghij"
    words = {"common" + "".join(rng.choice(letters) for _ in range(4)) for _ in range(500)} | {"".join(rng.choice(letters) for _ in range(4)) + "ending" for _ in range(500)}
    words |= {"z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 150, "a", "b", "ab"}
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
    table = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    tables = Tables(spark)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(table, tables, 16).collect()}
    want = {w: (n, fn) for w, _, _, _, n, fn in plain_spelling(counts) if n}
    assert {w: x[0] for w, x in got.items()} == {w: x[0] for w, x in want.items()}
    best = {w: min((x for x in words if near(w, x)), key=lambda v: (-counts[v], v)) for w in want}
    assert {w: x[2] for w, x in got.items()} == best
    chain = spark.createDataFrame([("w%d" % k, "w%d" % (k + 1)) for k in range(9)] + [("v", "w0")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.with_roots(chain, tables).collect()} == {**{"w%d" % k: "w9" for k in range(9)}, "v": "w9"}


def plain_importance(docs, target):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    own, wanted = [features(t) for _, t in docs], Counter(b for t in target for b in features(t)[1])
    s, S, T = Counter(b for _, f in own for b in f), sum(len(f) for _, f in own), sum(wanted.values())
    out = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_importance_equals_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["The", "of", "Été", "語", "x1", "a-b", "the,", "w%d" % rng.randrange(90)]) for _ in range(n))
    docs = [(i, say(rng.randrange(60))) for i in range(400)] + [(500, None), (501, ""), (502, "one"), (503, "one two"), (None, say(30)), (None, None), (504, say(300_000))]
    docs += [(505, docs[0][1]), (505, docs[0][1]), (506, " \n,"), (507, "a" * 100_000)]
    target = [say(40) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(made(spark, docs), table).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(tuple(r) for r in got) == plain_importance(docs, target)
    got = importance.resample(made(spark, docs[:50]), table.limit(0), percent=100, least_words=0).select("rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 51))


def test_ranks_of_equal_rows(spark):
    docs = [(1, "word " * 30)] * 40 + [(2, "other " * 30)] * 20
    got = importance.resample(made(spark, docs), spark.createDataFrame([("other other",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    assert Counter(tuple(r)[:4] + (r["rank"] is not None,) for r in got).most_common(1)[0][1] >= 20


def test_empty_tables(spark, bpe):
    none = spark.createDataFrame([], KIND)
    assert bpe_encoding.digests(bpe_encoding.encode(none, bpe), bpe).count() == 0
    assert spelling.variant_groups(none).count() == 0
    assert importance.resample(none, none).count() == 0
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in importance.resample(only_null, none).select("n_features", "weight", "rank").collect()] == [(0, 0, None)]
    assert spelling.variant_groups(only_null).count() == 0


@pytest.mark.parametrize("name", ["op11_bpe_encoding", "op12_spelling_variants", "op13_importance_resampling"])
def test_queries_take_all_documents(spark, small, name):
    from sparkwarden.llm import registry

    got = registry.queries()[name](spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert got.count() == n if name != "op12_spelling_variants" else got.filter(F.col("n_near") > 0).count() > 0
