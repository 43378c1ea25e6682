"""Target-distribution importance resampling of documents by hashed word runs.

A document's features are its runs of one to three words; a feature is known by its bucket only. Tasks write each block
of documents as one packed stream of 16-bit buckets with the offsets of its documents. A task sorts a stream and
run-length encodes it; Spark adds the runs up to one count per bucket, for the documents and for the target. A bucket's
gain is the logarithm of how much likelier it is in the target. Gains are then gathered along the streams and added per
document; Gumbel noise, a function of the document's id, turns a draw without replacement into a choice of the highest
scores.

What is collected and broadcast has one number per bucket, however large the corpus. Ranks come from a sort by range.

Defined cases: null text has no words, so no features and weight 0. Words run on over any length of text; a text longer
than a block makes a block of its own. Rows that share an id count as documents of their own, with the same noise; of
equal scores the smaller id goes first, null ids last, and a null id is an empty text in the noise. Empty tables give no
rows; an empty target has no features. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, blocks
from .ranks import in_order
from .shared import Tables, thrifty

BUCKETS = 10_000
RUN = 3
#: Documents with fewer words are never drawn; of the others this percentage is.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Bytes of text of a block: its stream takes about as much.
_BLOCK = 4 << 20
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if ALNUM[c] else 0x20 for c in range(256))
STREAM = "ids binary, known binary, words binary, starts binary, stream binary"


def _buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to longest words, the shortest first. CRC-32 of a run goes on from that of the run without its last word."""
    later = [b" " + w for w in words]
    sums = list(map(zlib.crc32, words))
    out = [sums]
    for k in range(1, min(longest, len(words))):
        sums = list(map(zlib.crc32, later[k:], sums))
        out.append(sums)
    return np.concatenate([np.array(x, np.uint32) % np.uint32(buckets) for x in out]).astype(np.uint16) if words else np.empty(0, np.uint16)


def _streamed(longest: int, buckets: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", _BLOCK):
            ids, known = block.ints("_id")
            parts, n_words = [], np.zeros(len(block), np.int64)
            for i in range(len(block)):
                words = block.text(i).translate(_CLEAN).split()
                n_words[i] = len(words)
                parts.append(_buckets(words, longest, buckets))
            starts = np.cumsum([0] + [len(p) for p in parts]).astype(np.int64)
            row = [ids, known.astype(np.uint8), n_words, starts, np.concatenate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["ids", "known", "words", "starts", "stream"])

    return run


def _runs(buckets: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for stream in b.column("stream"):
                x = np.sort(np.frombuffer(stream.as_buffer(), np.uint16), kind="stable")
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
                total[x[first]] += np.diff(np.append(first, len(x)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row per block of documents: their ids, numbers of words, offsets, and the packed 16-bit buckets of their features."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_streamed(longest, buckets), STREAM)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features per bucket: as many numbers as there are buckets."""
    counts = streams.select("stream").mapInArrow(_runs(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target to its share in the source, one added to every count."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    one = lambda s, t: math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
    return np.array([one(source.get(b, 0), target.get(b, 0)) for b in range(buckets)], np.int64)


def _noise(doc: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(sent, seed: int):
    @thrifty
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)) for c in ("ids", "known", "words", "starts", "stream")), strict=True):
                ids, known, words, starts, stream = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, np.uint8, np.int64, np.int64, np.uint16), strict=True))
                n = np.diff(starts)
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(gain[stream], starts[:-1][some])
                noise = np.fromiter((_noise(str(i) if k else "", seed) for i, k in zip(ids.tolist(), known.tolist(), strict=True)), np.int64, len(n))
                at = (random.getrandbits(38) << 24) + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(n), pa.array(words), pa.array(weight), pa.array(weight + noise), pa.array(at)], ["doc_id", "n_features", "n_words", "weight", "score", "at"])

    return run


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and its rank (from 1) if it is drawn, else null."""
    spark = docs.sparkSession
    tables = Tables(spark)
    streams = tables.written(bucket_streams(docs, id_col, text_col, longest, buckets), "bucket_streams")
    wanted = bucket_streams(target.select(F.lit(0).alias("_none"), F.col(target_col).alias("_wanted")), "_none", "_wanted", longest, buckets)
    sent = spark.sparkContext.broadcast(gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets), buckets))
    scored = tables.written(streams.mapInArrow(_weighed(sent, seed), "doc_id long, n_features long, n_words long, weight long, score long, at long"), "scored")
    tables.drop(streams)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ordered = in_order(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()], "rank", tables)
    ranks = ordered.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranks.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: weights, scores and ranks of all documents against the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text"))
