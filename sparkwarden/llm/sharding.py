"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, where copies of one text stay together.

Partial partitions hold one sum per shard. The two of largest spread are combined again and again, the largest sum of
one with the smallest of the other, until one is left. Spark sums the groups and deals them to as many buckets as there
are shuffle partitions; each bucket is differenced in a task. The buckets' own partial partitions, a few numbers each,
are then differenced in the same way on the driver, with the groups that weigh more than one part in LARGE of all bytes;
there are fewer than LARGE of these, whatever the data.

Defined cases: null text counts as empty, so it is a copy of empty text. Groups are told apart by 96 bits of hashes and
their size. A group heavier than a shard's share leaves its shard the largest; the others then share the rest. Rows that
share an id are sharded each on its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .shared import partitions, written

SHARDS = 16
LARGE = 4096


def difference(parts: list[list[int]]) -> tuple[list[int], np.ndarray]:
    """Karmarkar-Karp over partial partitions, each a list of k sums.

    Returns the k final sums, and for each input the final place of each of its k sums.
    """
    k = len(parts[0])
    heap = [(min(p) - max(p), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    sums = dict(enumerate(parts))
    joined: list[tuple[int, int, list[int], list[int]]] = []  # left, right, and the place of each of their sums
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        a, b = sums.pop(i), sums.pop(j)
        down = sorted(range(k), key=lambda x: -a[x])
        up = sorted(range(k), key=b.__getitem__)
        place_a, place_b = [0] * k, [0] * k
        for at, (x, y) in enumerate(zip(down, up, strict=True)):
            place_a[x] = place_b[y] = at
        new = [a[x] + b[y] for x, y in zip(down, up, strict=True)]
        n = len(parts) + len(joined)
        joined.append((i, j, place_a, place_b))
        sums[n] = new
        heapq.heappush(heap, (min(new) - max(new), n))
    root = heap[0][1]
    place = np.empty((len(parts) + len(joined), k), np.int32)
    place[root] = np.arange(k)
    for n in range(len(joined) - 1, -1, -1):
        i, j, a, b = joined[n]
        own = place[len(parts) + n]
        place[i], place[j] = own[a], own[b]
    return sums[root], place[: len(parts)]


def _balanced(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            t = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            sums, place = difference([[w] + [0] * (shards - 1) for w in t.column(t.schema.get_field_index("weight")).to_pylist()])
            bin_ = place[:, 0]
            keep = ["h", "crc", "size", "bucket"]
            load = np.array(sums, np.int64)[bin_]
            yield pa.RecordBatch.from_arrays([*(t.column(t.schema.get_field_index(c)) for c in keep), pa.array(bin_, pa.int32()), pa.array(load)], [*keep, "bin", "bin_bytes"])

    return run


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard); size: UTF-8 bytes of the text and 1."""
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "document_sizes")
    groups = written(rows.groupBy("h", "crc", "size").agg(F.sum("size").alias("weight")).withColumn("bucket", F.pmod(F.xxhash64("h", "crc"), F.lit(n)).cast("int")), "text_groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") > total / LARGE
    small = groups.filter(~heavy)
    local = written(small.repartitionById(n, small["bucket"]).mapInArrow(_balanced(shards), "h long, crc long, size long, bucket int, bin int, bin_bytes long"), "local_shards")
    # At most a number for each bucket and shard.
    loads: dict[int, list[int]] = {}
    for r in local.select("bucket", "bin", "bin_bytes").distinct().collect():
        loads.setdefault(r["bucket"], [0] * shards)[r["bin"]] = r["bin_bytes"]
    names = sorted(loads)
    large = groups.filter(heavy).select("h", "crc", "size", "weight").orderBy("h", "crc", "size").collect()
    singles = [[r["weight"]] + [0] * (shards - 1) for r in large]
    places = difference(singles + [loads[b] for b in names])[1] if singles or names else []
    of_bin = [(b, x, int(places[len(large) + i, x])) for i, b in enumerate(names) for x in range(shards)]
    of_large = [(r["h"], r["crc"], r["size"], int(places[i, 0])) for i, r in enumerate(large)]
    to = spark.createDataFrame(of_bin, "bucket int, bin int, shard int")
    groups = local.join(F.broadcast(to), ["bucket", "bin"]).select("h", "crc", "size", "shard")
    # Rows of heavy groups, fewer than LARGE, meet their shard by broadcast, so that no text is a hot key of the other join.
    rows = rows.join(F.broadcast(spark.createDataFrame(of_large, "h long, crc long, size long, shard int")), ["h", "crc", "size"], "left")
    rest = rows.filter("shard IS NULL").drop("shard").join(groups, ["h", "crc", "size"])
    placed = written(rows.filter("shard IS NOT NULL").unionByName(rest).select("doc_id", "size", "crc", "shard", "at"), "sharded")
    out = ranked(placed, "shard", ["doc_id"], "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the shard and slot of every document."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
