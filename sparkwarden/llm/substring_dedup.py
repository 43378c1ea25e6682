"""Substring dedup over words: every window of `width` words is hashed (Rabin-Karp) and counted across documents in Spark.

A window is repeated in a document if its word sequence also starts in a document with a smaller id. Repeated windows
merge into maximal intervals, whose words are removed. Windows are judged on the input, not on what is left.

Defined cases: null, empty or blank text has no words and loses none. Documents of fewer than `width` words have no
window. A null id is neither smaller nor larger than any other: such rows lose nothing and remove nothing. Rows that
share an id do not remove each other's words; equal ones get equal results. Any other columns pass through.
Windows are told apart by the partition and 56 more bits of a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed
from .arrays import SPACED, blocks, find_words, runs, span_hashes, window_hashes
from .shared import IdFilter, partitions, thrifty, written

WIDTH = 50


def first_owner(order: np.ndarray, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each entry the smallest owner that has its hash. order: argsort of h."""
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    out = np.empty(len(h), owner.dtype)
    if len(s):
        out[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(s))))
    return out


def _hashed(width: int, n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            w = find_words(block.data, block.offs, SPACED)
            h, text, pos = window_hashes(span_hashes(block.data, w.starts, w.ends), w.first, width)
            ids, known = block.ints("_id")
            if not known.all():
                at = known[text]
                h, text, pos = h[at], text[at], pos[at]
            if not len(h):
                continue
            tags = block.tags()
            owner = ids[text]
            # Of a window that several documents of this block have, only the first document's goes on to be counted.
            late = owner > first_owner(np.argsort(h), h, owner)
            go = ~late
            yield from packed.pack(0, packed.bucket_of(h[go], n), text[go], ids, tags, [h[go]], {"p": pos[go]})
            if late.any():
                spread = (tags[text[late]] % np.uint32(n)).astype(np.int32)
                yield from packed.pack(1, spread, text[late], ids, tags, [], {"p": pos[late]}, 1)

    return run


def _counted(n: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, known = packed.unpack(batches, 1, ["p"])
        h, owner = e.hashes[0], e.ids[e.text]
        late = owner > first_owner(np.argsort(h), h, owner)
        ids = np.concatenate([owner[late], known.ids[known.text]])
        tags = np.concatenate([e.tags[e.text[late]], known.tags[known.text]])
        yield from packed.replies(n, ids, tags, {"p": np.concatenate([e.numbers["p"][late], known.numbers["p"]])})

    return run


@thrifty
def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, e = packed.unpack(batches, 1, ["p"])
    if len(e.text):
        yield packed.by_text(e.ids[e.text], e.tags[e.text], [e.numbers["p"]], ["pos"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, tag, pos): starts of a document's repeated windows as 32-bit numbers. tag: the text's CRC-32."""
    n = partitions(docs.sparkSession)
    hashed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_hashed(width, n), packed.schema(["p"], 1))
    late = packed.dealt(hashed).mapInArrow(_counted(n), packed.schema(["p"], 1))
    return packed.dealt(late).mapInArrow(_gathered, "doc_id long, tag long, pos binary")


def _finish(width: int, columns: list[str]):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            rows = block.rows
            n_words, n_removed, kept = [], [], []
            for i, pos in enumerate(rows.column("_pos").to_pylist()):
                words = block.text(i).split()
                n_words.append(len(words))
                gone = 0
                if pos:
                    left, end = [], 0
                    for lo, hi in zip(*runs(np.sort(np.frombuffer(pos, np.uint32).astype(np.int64)), width, len(words)), strict=True):
                        left += words[end:lo]
                        gone += int(hi - lo)
                        end = hi
                    words = left + words[end:]
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*columns, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """The rows with columns `keep` (default: all), n_words, n_removed and kept_text, the kept words joined by one space.

    Columns of docs by the names n_words, n_removed or kept_text are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_removed", "kept_text")]
    flags = written(repeated_windows(docs, id_col, text_col, width), "repeated_windows")
    safe = {c: f"_c{i}" for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in safe.items()), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = IdFilter(flags, "doc_id").mark(rows, "_id", "_maybe")
    names = list(safe.values())
    done = T.StructType([*(T.StructField(a, docs.schema[c].dataType) for c, a in safe.items()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    clean = rows.filter("NOT _maybe").select(*names, "_text", F.lit(None).cast("binary").alias("_pos"))
    flags = flags.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("pos").alias("_pos"))
    touched = rows.filter("_maybe").withColumn("_tag", F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))).join(flags, ["_id", "_tag"], "left").select(*names, "_text", "_pos")
    out = clean.mapInArrow(_finish(width, names), done).unionByName(touched.mapInArrow(_finish(width, names), done))
    return out.select(*(F.col(a).alias(c) for c, a in safe.items()), "n_words", "n_removed", "kept_text")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: removed and kept words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_windows(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: Windows are compared as joined words; words hold no space, so this is exact.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM d WHERE len(w) >= 50
), keyed AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS k FROM win
), firsts AS (
  SELECT k, min(doc_id) AS m FROM keyed GROUP BY k
), bad AS (
  SELECT DISTINCT keyed.doc_id, keyed.i + o.o AS p FROM keyed JOIN firsts ON keyed.k = firsts.k AND keyed.doc_id > firsts.m, (SELECT unnest(range(0, 50)) AS o) o
), gone AS (
  SELECT doc_id, list(p) AS ps FROM bad GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
         CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS k
  FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
