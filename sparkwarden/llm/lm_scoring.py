r"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts, in slices.

Spark counts words and pairs of neighbouring words of the training documents (those whose id, as text, has a CRC-32 that
is not 0 modulo 10). A count c is quantised to level 1 + floor(2 log2 c), and the filter holds (n-gram, 1), ..., (n-gram,
level): levels are probed until one is missing. Every target partition owns a slice of the filter, made where its
counts are. A word's probability mixes the share of its pair among the pairs of the word before it, and its own share:
PAIR * c(v w) / c(v) + (1 - PAIR) * (c(w) + 0.1) / (N + 0.1 (V + 1)). All words and pairs are stored, those seen once too.

The base score needs exact counts. Words of more than one in FREQUENT of all tokens (fewer than FREQUENT words) are sent
to all workers; the other words of each document meet their counts in their partition.

Size of the filter: it grows with the n-grams, BITS bits for each level of each. Its slices of words are broadcast. Those
of pairs, far more, stay in the shared folder: the distinct pairs of each text are sent to the partition of their slice,
with the levels of their words, and the sum of their logarithms comes back. Pairs as frequent as FREQUENT words are sent to
all workers with their counts instead, so that none fills a partition. A block of texts sends one row to each partition, in
which a text is the step to its place in the block; with more partitions a text meets more of them, and its id in each would
outweigh the pairs. What is known of the block's texts waits where the answers come together.

Defined cases: null text is empty: its end is its only token. A null id counts as empty text in the split, so such rows
are held out. Rows that share an id are scored each on its own. Without training tokens no token is known. A task that is run
again must read the same rows in the same order, as files give them; otherwise the query fails.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .arrays import LOWER, SPACED, U64, Block, blocks, find_words, mix, span_hashes
from .shared import Tables, partitions, thrifty

PAIR = 0.2
FREQUENT = 1 << 18
BITS, PROBES = 10, 7
LOW = U64((1 << 56) - 1)
_END, _START = U64(0x1BADB002CAFEF00D), U64(0x0DDBA11C0FFEE123)
_WORD, _PAIR = 0, 1
#: Kinds of packed rows besides packed.py's 0 and 1: totals of words, pairs of texts, filter slices of pairs, sums of texts, a block's texts.
_TOTALS, _ASKED_PAIRS, _SLICE, _SUMS, _TEXTS = 2, 3, 4, 5, 6
#: Numbers of an entry that is asked or answered: the text's place in its block, and two that depend on the kind.
_NUMBERS = ["t", "c", "k"]
#: What a block knows of a text: known of its id, and of its frequent words and pairs.
_TEXT = np.dtype([("id", "<i8"), ("known", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("logs", "<f8")])
#: In one number: the level of a pair's first word, times this, and the level of its second.
_LEVELS = 128


def held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.fromiter(((zlib.crc32(str(i).encode()) if k else 0) % 10 == 0 for i, k in zip(ids.tolist(), known.tolist(), strict=True)), bool, len(ids))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (words and one end for each text), hash of its pair with the token before, and its text."""
    data = LOWER[block.data]
    w = find_words(data, block.offs, SPACED)
    n = w.counts + 1
    text = np.repeat(np.arange(len(block)), n)
    end = np.cumsum(n) - 1
    h = np.empty(len(text), U64)
    inside = np.ones(len(text), bool)
    inside[end] = False
    h[inside], h[end] = span_hashes(data, w.starts, w.ends), _END
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[end - n + 1] = _START
    return h, pairs(before, h), text


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9FB21C651E98DF25) + (h ^ U64(0x3C6EF372FE94F82B)))


def _sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(count[order], first) if len(k) else np.empty(0, np.int64)


_NOBODY = np.zeros(1, np.int64), np.zeros(1, np.uint32)


def _counted(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            ids, known = block.ints("_id")
            train = ~held_out(ids, known)
            h, pair, text = tokens(block)
            at = train[text]
            starts = np.array([_START] * int(train.sum()), U64)
            for kind, x in ((_WORD, np.concatenate([h[at], starts])), (_PAIR, pair[at])):
                k, c = _sums(x, np.ones(len(x), np.int64))
                yield from packed.pack(0, packed.bucket_of(k, n), np.zeros(len(k), np.int64), *_NOBODY, [k], {"c": c, "k": np.full(len(k), kind)})

    return run


COUNTS = "bucket int, w_keys binary, w_counts binary, w_bits binary, p_keys binary, p_counts binary, p_bits binary, n_tokens long, n_distinct long"


def _totalled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of COUNTS for a bucket: totals of its words, its slices of words and pairs, and totals of pairs that may be frequent."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    bucket = own[0].column("bucket").slice(0, 1)
    e, _ = packed.unpack(own, 1, ["c", "k"])
    del own
    h, c, kind = e.hashes[0], e.numbers["c"], e.numbers["k"]
    w, wc = _sums(h[kind == _WORD], c[kind == _WORD])
    p, pc_ = _sums(h[kind == _PAIR], c[kind == _PAIR])
    words = w != _START & LOW
    often = pc_ > pc_.sum() / FREQUENT  # of all tokens there are more, so no frequent pair is missed
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    cols = [bucket.cast(pa.int32()), binary(w), binary(wc.astype(np.uint32)), binary(_slice(w, wc, _WORD)), binary(p[often]), binary(pc_[often].astype(np.uint32)), binary(_slice(p, pc_, _PAIR)), pa.array([int(wc[words].sum())]), pa.array([int(words.sum())])]
    yield pa.RecordBatch.from_arrays(cols, ["bucket", "w_keys", "w_counts", "w_bits", "p_keys", "p_counts", "p_bits", "n_tokens", "n_distinct"])


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(c, 1)) + 1e-9).astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, 0 for level 0."""
    return np.where(levels > 0, np.where(levels == 1, 1.0, 2 ** ((levels - 0.5) / 2)), 0.0)


def _positions(key: np.ndarray, lev: np.ndarray | int, kind: int, i: int, size: np.ndarray) -> np.ndarray:
    x = mix(key * U64(4) + U64(kind) + np.asarray(lev).astype(U64) * U64(0x9E3779B97F4A7C15))
    return ((x & U64(0xFFFFFFFF)) + U64(i) * ((x >> U64(32)) | U64(1))) % size


def slice_bits(keys: np.ndarray, levels: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """A filter slice of size bits as bytes."""
    out = np.zeros(size, bool)
    lev = 1
    while len(keys):
        for which in (_WORD, _PAIR):
            own = keys[kind == which]
            for i in range(PROBES):
                out[_positions(own, lev, which, i, U64(size)).astype(np.int64)] = True
        lev += 1
        go = levels >= lev
        keys, levels, kind = keys[go], levels[go], kind[go]
    return np.packbits(out, bitorder="little")


def _slice(keys: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    lev = level(counts)
    return slice_bits(keys, lev, np.full(len(keys), kind), -(-(BITS * int(lev.sum()) + 64) // 64) * 64)


class LogFrequencyFilter:
    """All slices: bits, and each slice's first byte and number of bits."""

    def __init__(self, slices: dict[int, bytes], n: int):
        sizes = np.array([8 * len(slices.get(b, b"")) for b in range(n)], np.int64)
        self.n, self.sizes, self.first = n, sizes.astype(U64), np.cumsum(sizes // 8) - sizes // 8
        self.bits = np.frombuffer(b"".join(slices.get(b, b"") for b in range(n)), np.uint8)

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The highest level up to which no probe misses."""
        out = np.zeros(len(h), np.int64)
        bucket = packed.bucket_of(h, self.n)
        size, first, key = self.sizes[bucket], self.first[bucket], h & LOW
        alive = np.flatnonzero(size)
        lev = 1
        while len(alive):
            for i in range(PROBES):
                p = _positions(key[alive], lev, kind, i, size[alive]).astype(np.int64)
                alive = alive[(self.bits[first[alive] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = lev
            lev += 1
        return out


def _often(least: float, kind: str):
    """Words (kind w) or pairs (kind p) with a count above least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, counts = np.frombuffer(r[f"{kind}_keys"], U64), np.frombuffer(r[f"{kind}_counts"], np.uint32)
                go = (counts > least) & (keys != _START & LOW)
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([keys[go].tobytes()], pa.binary()), pa.array([counts[go].tobytes()], pa.binary())], ["bucket", "keys", "counts"])

    return run


class Frequent:
    """Exact counts of the frequent words or pairs."""

    def __init__(self, found: list[tuple[int, bytes, bytes]], n: int):
        keys = [np.frombuffer(k, U64) for _, k, _ in found] or [np.empty(0, U64)]
        order = np.argsort(np.concatenate(keys))
        self.n = n
        self.keys = np.concatenate(keys)[order]
        self.buckets = np.repeat([b for b, _, _ in found], [len(k) for k in keys])[order] if found else np.empty(0, np.int64)
        self.counts = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in found] or [np.empty(0, np.uint32)])[order].astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The count of each, 0 where it is not frequent."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h & LOW), len(self.keys) - 1)
        return np.where((self.keys[at] == h & LOW) & (self.buckets[at] == packed.bucket_of(h, self.n)), self.counts[at], 0)


def _logs(before: np.ndarray, word: np.ndarray, both: np.ndarray, total: float) -> np.ndarray:
    """Logarithms of probabilities, from the levels of the word before, the word and their pair."""
    v = value(before)
    share = np.minimum(1.0, np.divide(value(both), v, out=np.zeros(len(v)), where=v > 0))
    return np.log10(PAIR * share + (1 - PAIR) * (value(word) + 0.1) / total)


def _distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash of each text is first, by text and hash; and how often the text has it."""
    order = np.argsort(h)
    order = order[np.argsort(text[order], kind="stable")]
    h, text = h[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.empty(0, np.int64)
    return order[first], np.diff(np.append(first, len(h)))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where an entry differs from the one before it in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out


def _name(block: Block, ids: np.ndarray, part: int, number: int) -> np.ndarray:
    """One number for a block: its upper half deals blocks evenly (packed.bucket_of), its lower half depends on what is in it."""
    place = int((part * 0.6180339887498949 + number * 0.4142135623730951) % 1 * (1 << 32))
    held = hashlib.blake2b(f"{part} {number}".encode(), digest_size=4)
    for x in (ids, block.offs, block.data):
        held.update(np.ascontiguousarray(x))
    return np.array([place << 32 | int.from_bytes(held.digest(), "little")], U64).view(np.int64)


def _one_row(bucket: int, kind: int, ids: bytes, tags: bytes, held: bytes) -> pa.RecordBatch:
    planes = [f"{c}{k}" for c in _NUMBERS for k in range(4)]
    values = [ids, tags, b"", held] + [b""] * len(planes)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in values)], ["bucket", "kind", "ids", "tags", "counts", "h0", *planes])


def _asked(sent, n: int, total: float):
    """Words and pairs of each text that are not frequent; and what is known of the texts themselves."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, often = sent.value
        start = model.levels(np.array([_START], U64), _WORD)[0]
        part = TaskContext.get().partitionId()
        for number, block in enumerate(blocks(batches, "_text")):
            ids, known = block.ints("_id")
            own = _name(block, ids, part, number), np.zeros(1, np.uint32)
            h, pair, text = tokens(block)
            word, at = np.unique(h, return_inverse=True)
            lev = model.levels(word, _WORD)[at]
            before = np.concatenate([[start], lev[:-1]])
            before[np.concatenate([[True], text[1:] != text[:-1]])] = start
            count = often.of(pair)
            here = count > 0
            exact = frequent.of(word)[at]
            s = lambda x, t=text: np.bincount(t, weights=x, minlength=len(block))  # noqa: B023, E731
            texts = np.zeros(len(block), _TEXT)
            texts["id"], texts["known"], texts["held_out"] = ids, known, held_out(ids, known)
            texts["n_tokens"], texts["n_known"] = np.bincount(text, minlength=len(block)), s(exact > 0)
            texts["base"] = s(np.where(exact > 0, np.log10((exact + 0.1) / total), 0.0))
            texts["logs"] = s(_logs(before[here], lev[here], level(count[here]), total), text[here])
            away = np.flatnonzero(~here)
            first, times = _distinct(pair[away], text[away])
            first = away[first]
            bucket = packed.bucket_of(pair[first], n)
            yield _one_row(int(packed.bucket_of(own[0].view(U64), n)[0]), _TEXTS, own[0].tobytes(), np.uint32(len(np.unique(bucket))).tobytes(), texts.tobytes())
            yield from packed.pack(_ASKED_PAIRS, bucket, np.zeros(len(first), np.int64), *own, [pair[first]], {"t": text[first], "c": times, "k": before[first] * _LEVELS + lev[first]})
            rare = np.flatnonzero(exact == 0)
            first, times = _distinct(h[rare], text[rare])
            first = rare[first]
            yield from packed.pack(0, packed.bucket_of(h[first], n), np.zeros(len(first), np.int64), *own, [h[first]], {"t": text[first], "c": times, "k": np.zeros(len(first))})

    return run


def _of_kind(batches: list[pa.RecordBatch], kind: int) -> list[pa.RecordBatch]:
    return [x for b in batches if (x := b.filter(pc.equal(b.column("kind"), kind))).num_rows]


def _replies(kind: int, n: int, e: packed.Entries, at: np.ndarray | slice, c: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers c and k for the entries at these places, to where their blocks' texts wait."""
    row = e.text[at]
    yield from packed.pack(kind, packed.bucket_of(e.ids.view(U64), n)[row], row, e.ids, e.tags, [], {"t": e.numbers["t"][at], "c": c, "k": k}, 1)


def _floats(e: packed.Entries) -> np.ndarray:
    return np.ascontiguousarray(np.stack([e.numbers["k"], e.numbers["c"]], axis=1).astype(np.uint32)).view("<f8").ravel()


def _answered(n: int, total: float):
    """Replies: training count c of a word (0: unknown) and how often the text has it, k. Sums over pairs of texts, a float as two numbers."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        yield from _of_kind(batches, _TEXTS)
        asked = packed.unpack(_of_kind(batches, _ASKED_PAIRS), 1, _NUMBERS, more=_ASKED_PAIRS)[2]
        slices = [x for b in _of_kind(batches, _SLICE) for x in b.column("h0").to_pylist()]
        batches = [x for kind in (0, _TOTALS) for x in _of_kind(batches, kind)]
        key, at = np.unique(asked.hashes[0], return_inverse=True)
        both = LogFrequencyFilter(dict(enumerate(slices)), 1).levels(key, _PAIR)[at]
        logs = asked.numbers["c"] * _logs(asked.numbers["k"] // _LEVELS, asked.numbers["k"] % _LEVELS, both, total)
        new = _heads(asked.text, asked.numbers["t"])
        halves = np.bincount(np.cumsum(new) - 1, weights=logs).astype("<f8").view(np.uint32).reshape(-1, 2)
        yield from _replies(_SUMS, n, asked, new, halves[:, 1], halves[:, 0])
        del asked, both, logs, key, at, new
        e, _, totals = packed.unpack(batches, 1, _NUMBERS, more=_TOTALS)
        order = np.argsort(totals.hashes[0]) if len(totals.ids) else np.empty(0, np.int64)
        key, count = (totals.hashes[0][order], totals.numbers["c"][order]) if len(order) else (np.empty(0, U64), order)
        c = np.zeros(len(e.text), np.int64)
        if len(key) and len(c):
            at = np.minimum(np.searchsorted(key, e.hashes[0]), len(key) - 1)
            c = np.where(key[at] == e.hashes[0], count[at], 0)
        yield from _replies(1, n, e, slice(None), c, e.numbers["c"])

    return run


def _summed(total: float):
    """The rows of texts, when all answers to their blocks are there."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        found = [r for b in _of_kind(batches, _TEXTS) for r in zip(*(b.column(c).to_pylist() for c in ("ids", "tags", "h0")), strict=True)]
        _, e, p = packed.unpack([x for kind in (1, _SUMS) for x in _of_kind(batches, kind)], 1, _NUMBERS, more=_SUMS)
        del batches
        found = sorted((int.from_bytes(a, "little", signed=True), int.from_bytes(b, "little"), x) for a, b, x in found)
        name, asked = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
        texts = np.frombuffer(b"".join(r[2] for r in found), _TEXT)
        size = np.array([len(r[2]) // _TEXT.itemsize for r in found], np.int64)
        first = np.cumsum(size) - size
        of = lambda ids: np.minimum(np.searchsorted(name, ids), max(len(name) - 1, 0))
        strange = any(len(x.ids) and (not len(name) or (name[of(x.ids)] != x.ids).any()) for x in (e, p))
        if strange or (np.bincount(of(p.ids), minlength=len(name)) != asked).any():
            raise RuntimeError("answers do not belong to these texts: a task that was run again read other rows, or in another order")
        if not len(texts):
            return

        def add(found: packed.Entries, values: np.ndarray) -> np.ndarray:
            at = first[of(found.ids)][found.text] + found.numbers["t"]
            order = np.lexsort((values, at))  # the same sum in whatever order answers come
            return np.bincount(at[order], weights=values[order], minlength=len(texts))

        c, k = e.numbers["c"], e.numbers["k"]
        n_known = texts["n_known"] + add(e, np.where(c > 0, k, 0)).astype(np.int64)
        base = texts["base"] + add(e, k * np.log10((c + 0.1) / total))
        cols = [pa.array(texts["id"], mask=~texts["known"]), pa.array(texts["held_out"]), pa.array(texts["n_tokens"]), pa.array(n_known), pa.array(base), pa.array(texts["logs"] + add(p, _floats(p)))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _as_packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word totals as packed entries, and the slice of pairs as one row, in their buckets."""
    for b in batches:
        for bucket, keys, counts, bits in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "w_keys", "w_counts", "p_bits")), strict=True):
            k = np.frombuffer(keys, U64)
            none = np.zeros(len(k), np.int64)
            yield from packed.pack(_TOTALS, np.full(len(k), bucket), none, *_NOBODY, [k], {"t": none, "c": np.frombuffer(counts, np.uint32), "k": none})
            yield _one_row(bucket, _SLICE, b"", b"", bits)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n = partitions(spark)
    tables = Tables(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    totals = tables.written(packed.dealt(rows.mapInArrow(_counted(n), packed.schema(["c", "k"], 1))).mapInArrow(_totalled, COUNTS), "ngram_counts")
    sums = totals.agg(F.sum("n_tokens").alias("n"), F.sum("n_distinct").alias("v")).first()
    n_train, v = sums["n"] or 0, sums["v"] or 0
    total = n_train + 0.1 * (v + 1)
    slices = totals.select("bucket", "w_bits").collect()
    often = [totals.mapInArrow(_often(n_train / FREQUENT, c), "bucket int, keys binary, counts binary").collect() for c in "wp"]
    model = LogFrequencyFilter({r["bucket"]: bytes(r["w_bits"]) for r in slices}, n)
    del slices
    sent = spark.sparkContext.broadcast((model, *(Frequent([(r["bucket"], bytes(r["keys"]), bytes(r["counts"])) for r in x], n) for x in often)))
    tables.release()  # not sooner: what the last jobs still held would outlive it
    kind = packed.schema(_NUMBERS, 1)
    asked = rows.mapInArrow(_asked(sent, n, total), kind).unionByName(totals.select("bucket", "w_keys", "w_counts", "p_bits").mapInArrow(_as_packed, kind))
    out = packed.dealt(packed.dealt(asked).mapInArrow(_answered(n, total), kind)).mapInArrow(_summed(total), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
