"""Exact dedup of byte strings by prefix-free parsing: a dictionary of phrases, a parse, and their order.

Every text is parsed into phrases by a rolling hash over `gram` bytes: a phrase is the stretch of all `width`-byte strings
that have the same trigger, the first smallest rolling hash in them. Where a phrase begins and ends depends on the bytes
alone, so equal strings have equal triggers, also in different surroundings. (The usual trigger, a hash that is 0 modulo
some number, can leave a long text without any; the smallest hash of a window bounds every phrase.)

The dictionary is the distinct phrases of each trigger; the parse has each phrase's occurrences in corpus order, by
document id, then by place. A phrase that occurs again is decided as a whole: all its strings also start earlier. What is
left are triggers with several different phrases, mostly where a repeated passage begins or ends. Of these the suffixes
that start a string are ordered by key and, among equal ones, by the parse; all but the first start earlier, too.
Removed are the bytes covered by strings that start earlier. Suffixes are ordered by a 64-bit key and not by their bytes,
because only equal neighbours matter here. A task sends a phrase, trigger or string once at most, so a passage that a
third of all documents share is no hot key. Whole texts are shuffled once, when phrases that occur again come to them; they
stay in buckets of their document then, and only positions are shuffled to them.

Defined cases: null text counts as empty; a text of fewer than `width` bytes loses nothing. Rows with a null id lose
nothing and remove nothing. Rows that share an id count as one document if their texts are equal; otherwise the one whose
text has the smaller CRC-32 comes first. Triggers, phrases and strings are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed
from .arrays import _BASE_BYTES, U64, Block, blocks, mix, powers, span_hashes
from .shared import IdFilter, Tables, partitions, thrifty

WIDTH, GRAM = 100, 40
_SPAN = 1 << 19


def phrases(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: each phrase's first string, number of strings, trigger hash, and hash of the bytes with the trigger's place."""
    n = len(data)
    strings, grams = n - width + 1, width - gram + 1
    if strings <= 0:
        e = np.empty(0, np.int64)
        return e, e, e.astype(U64), e.astype(U64)
    up, down = powers(_BASE_BYTES, _SPAN + 2 * width)
    out = []
    for lo in range(0, strings, _SPAN):
        hi = min(lo + _SPAN, strings)
        part = data[lo : hi + width - 1]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        # First smallest of each `grams` neighbours, by the high bits; the low bits hold the place.
        bits = U64(20)
        key = ((h >> bits) << bits) | np.arange(len(h), dtype=U64)
        pad = -len(key) % grams
        key = np.concatenate([key, np.full(pad, ~U64(0), U64)]).reshape(-1, grams)
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        ahead = np.minimum.accumulate(key, axis=1).ravel()
        k = hi - lo
        at = (np.minimum(back[:k], ahead[grams - 1 : grams - 1 + k]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, k))
        trigger = mix(h[at[first]] ^ U64(0xD6E8FEB86659FD93))  # smallest hashes are small numbers; these are spread again
        end = first + count - 1 + width
        whole = mix((sums[end] - sums[first]) * down[first] + (at[first] - first).astype(U64) * U64(0xA0761D6478BD642F) + count.astype(U64) * U64(0xE7037ED1A0B428DB))
        out.append((first + lo, count, trigger, whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parse(block: Block, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of all texts of a block: text, first string, number of strings, trigger, hash."""
    found = [phrases(block.data[a:b], width, gram) for a, b in zip(block.offs[:-1], block.offs[1:], strict=True)]
    text = np.repeat(np.arange(len(block)), [len(f[0]) for f in found])
    return text, *(np.concatenate(x) for x in zip(*found, strict=True))


#: In the number n of an entry: the phrase's strings are to be ordered (in a reply), or its block has several phrases of its trigger.
ASKED = 1 << 16


def _repeats(keys: list[np.ndarray], corpus: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one at an earlier place, in corpus order; and the first of each key.

    The first place may come more than once, from rows that share id and text: none of these is `again`.
    """
    order = np.lexsort((*corpus[::-1], *keys[::-1]))
    again, firsts = np.zeros(len(order), bool), order
    if len(order):
        head = np.concatenate([[True], ~_alike(keys, order)])
        # Of each run of equal entries, those at the place of its first.
        moved = np.concatenate([[False], ~_alike(corpus, order)]) & ~head
        moves = np.cumsum(moved)
        again[order] = moves > moves[np.flatnonzero(head)][np.cumsum(head) - 1]
        firsts = order[head]
    return again, firsts


def _alike(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Which entries, but the first, equal the one before them in this order."""
    same = np.ones(len(order) - 1, bool)
    for c in columns:
        x = c[order]
        same &= x[1:] == x[:-1]
    return same


def _crowded(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of the entries in this order, those whose key another one has."""
    x = key[order]
    out = np.zeros(len(key), bool)
    if len(x):
        same = x[1:] == x[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out[order] = several
    return out


def _parsed(width: int, gram: int, n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            text, first, count, trigger, whole = parse(block, width, gram)
            ids, known = block.ints("_id")
            ok = known[text]
            text, first, count, trigger, whole = (x[ok] for x in (text, first, count, trigger, whole))
            if not len(text):
                continue
            tags = block.tags()
            again, rest = _repeats([trigger, whole], [ids[text], tags[text], first])
            several = _crowded(rest, trigger)
            # One entry for each trigger of the block.
            t = trigger[rest]
            one = np.sort(rest[np.concatenate([[True], t[1:] != t[:-1]])])
            yield from packed.pack(0, packed.bucket_of(trigger[one], n), text[one], ids, tags, [trigger[one], whole[one]], {"p": first[one], "n": count[one] + ASKED * several[one]})
            told = again | several
            yield from packed.replies(n, ids[text[told]], tags[text[told]], {"p": first[told], "n": count[told] + ASKED * ~again[told]}, no_hashes=2)

    return run


def _decided(n: int):
    """Replies: a phrase is repeated as a whole, or its strings are to be ordered."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 2, ["p", "n"])
        ids, tags, p = e.ids[e.text], e.tags[e.text], e.numbers["p"]
        count, many = e.numbers["n"] % ASKED, e.numbers["n"] >= ASKED
        trigger, whole = e.hashes
        again, rest = _repeats([trigger, whole], [ids, tags, p])
        several = _crowded(rest, trigger)
        # A trigger with several phrases within one block has several.
        several |= np.isin(trigger, trigger[many])
        told = (again | several) & ~many
        yield from packed.replies(n, np.concatenate([known.ids[known.text], ids[told]]), np.concatenate([known.tags[known.text], tags[told]]), {"p": np.concatenate([known.numbers["p"], p[told]]), "n": np.concatenate([known.numbers["n"], count[told] + ASKED * ~again[told]])}, no_hashes=2)

    return run


def _gathered(hashes: int, numbers: list[str], names: list[str]):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, e = packed.unpack(batches, hashes, numbers)
        if len(e.text):
            yield packed.by_text(e.ids[e.text], e.tags[e.text], [e.numbers[c] for c in numbers], names)

    return run


def _strings(width: int, n: int):
    """The strings of phrases that were asked for, by their keys."""

    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            ids, tags = block.ints("_id")[0], block.ints("_tag")[0].astype(np.uint32)
            text, starts = [], []
            for i, (p, k) in enumerate(zip(block.rows.column("_pos").to_pylist(), block.rows.column("_n").to_pylist(), strict=True)):
                p, k = np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(k, np.uint32).astype(np.int64)
                p, k = p[k >= ASKED], k[k >= ASKED] - ASKED
                at = np.unique(np.repeat(p - np.cumsum(k) + k, k) + np.arange(k.sum()))
                starts.append(at)
                text.append(np.full(len(at), i))
            text, pos = np.concatenate(text), np.concatenate(starts)
            if not len(text):
                continue
            at = block.offs[:-1][text] + pos
            h = span_hashes(block.data, at, at + width)
            late, _ = _repeats([h], [ids[text], tags[text], pos])
            go = ~late
            yield from packed.pack(0, packed.bucket_of(h[go], n), text[go], ids, tags, [h[go]], {"p": pos[go]})
            yield from packed.replies(n, ids[text[late]], tags[text[late]], {"p": pos[late]})

    return run


def _ordered(n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 1, ["p"])
        ids, tags = e.ids[e.text], e.tags[e.text]
        late, _ = _repeats([e.hashes[0]], [ids, tags, e.numbers["p"]])
        yield from packed.replies(n, np.concatenate([known.ids[known.text], ids[late]]), np.concatenate([known.tags[known.text], tags[late]]), {"p": np.concatenate([known.numbers["p"], e.numbers["p"][late]])})

    return run


def _finish(width: int, columns: list[str]):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            rows = block.rows
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i, (pos, num, single) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("_pos", "_n", "_single")), strict=True)):
                data = block.data[block.offs[i] : block.offs[i + 1]]
                n_bytes.append(len(data))
                p, k = (np.frombuffer(x or b"", np.uint32).astype(np.int64) for x in (pos, num))
                p, k = p[k < ASKED], k[k < ASKED]
                one = np.frombuffer(single or b"", np.uint32).astype(np.int64)
                p, k = np.concatenate([p, one]), np.concatenate([k, np.ones(len(one), np.int64)])
                if not len(p):
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(data.tobytes())
                    continue
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, p, 1)
                np.add.at(depth, p + k - 1 + width, -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], [*columns, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """The rows with columns `keep` (default: all), n_bytes, n_removed, n_spans and kept_bytes (binary: cuts may fall within characters)."""
    n = partitions(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    new = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    safe = {c: f"_c{i}" for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in safe.items()), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    kind = packed.schema(["p", "n"], 2)
    counted = packed.dealt(rows.select("_id", "_text").mapInArrow(_parsed(width, gram, n), kind))
    flags = tables.written(packed.dealt(counted.mapInArrow(_decided(n), kind)).mapInArrow(_gathered(2, ["p", "n"], ["pos", "n"]), "doc_id long, tag long, pos binary, n binary"), "repeated_phrases")
    flags = flags.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("pos").alias("_pos"), F.col("n").alias("_n"))
    maybe = IdFilter(flags, "_id").mark(rows, "_id", "_maybe")
    tables.release()
    touched = tables.bucketed(maybe.filter("_maybe").withColumn("_tag", F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))).join(flags, ["_id", "_tag"], "left"), "touched_texts", "_id", "_tag")
    tables.release()
    asked = touched.filter("_pos IS NOT NULL").select("_id", "_tag", "_text", "_pos", "_n").dropDuplicates(["_id", "_tag"])
    kind = packed.schema(["p"], 1)
    late = packed.dealt(asked.mapInArrow(_strings(width, n), kind)).mapInArrow(_ordered(n), kind)
    single = packed.dealt(late).mapInArrow(_gathered(1, ["p"], ["pos"]), "doc_id long, tag long, pos binary")
    single = single.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("pos").alias("_single"))
    names = list(safe.values())
    done = T.StructType([*(T.StructField(a, docs.schema[c].dataType) for c, a in safe.items()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_bytes", T.BinaryType())])
    nothing = [F.lit(None).cast("binary").alias("_pos"), F.lit(None).cast("binary").alias("_n"), F.lit(None).cast("binary").alias("_single")]
    clean = maybe.filter("NOT _maybe").select(*names, "_text", *nothing)
    touched = touched.join(single, ["_id", "_tag"], "left").select(*names, "_text", "_pos", "_n", "_single")
    out = clean.mapInArrow(_finish(width, names), done).unionByName(touched.mapInArrow(_finish(width, names), done))
    return out.select(*(F.col(a).alias(c) for c, a in safe.items()), *new)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: removed and kept bytes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_bytes(docs, keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))
