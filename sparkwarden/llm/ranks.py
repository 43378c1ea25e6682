"""Gapless numbers within each value of a key, without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, partitions


def ranked(table: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """table with column name: 0, 1, 2, ... within each value of key.

    table: one that written() gave, with a column `at` of distinct numbers. Rows of a key are dealt to as many blocks as
    there are shuffle partitions; a block counts its own rows and starts where the blocks before it end. The table of
    starts has a row per key and block, so its size follows the settings and the number of keys, not the rows.
    """
    n = partitions(table.sparkSession)
    rows = table.withColumn("_block", F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n")).select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_block").orderBy(*order, "at")
    return rows.withColumn("_own", F.row_number().over(own)).join(starts, [key, "_block"]).withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_block", "_own", "_start")


def in_order(table: DataFrame, order: list[Column], name: str, tables: Tables) -> DataFrame:
    """table with column name: 1, 2, ... in one order over all rows, which must tell every two rows apart.

    Rows are sorted by range. A written row's number tells its partition and its place there; a partition starts where
    those before it end, which is one number per partition.
    """
    n = partitions(table.sparkSession)
    rows = table.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_no", F.monotonically_increasing_id())
    rows = tables.written(rows, "sorted").withColumn("_part", F.shiftright("_no", 33))
    starts, before = [], 0
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["n"]
    starts = table.sparkSession.createDataFrame(starts, "_part long, _start long")
    own = F.col("_no") - F.shiftleft(F.col("_part"), 33) + 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + own).drop("_no", "_part", "_start")
