"""Tables and bitmaps that driver and executors exchange through the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of an Arrow batch while tables are written: more would be held on both sides of a worker's pipe. One larger row goes alone.
ROWS, BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one on one machine, as in tests."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        root = getattr(shared_dir, "_own", None) or tempfile.mkdtemp(prefix="sparkwarden-")
        shared_dir._own = root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkwarden-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. Lost executors cost a rerun of tasks only."""
    return Tables(df.sparkSession).written(df, name)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ROWS rows and BYTES bytes for what is run inside; smaller settings stay."""
    before = {name: spark.conf.get(name) for name in (BATCH, BATCH_BYTES)}
    for (name, value), most in zip(before.items(), (ROWS, BYTES), strict=True):
        limit = int(value.removesuffix("b"))
        spark.conf.set(name, str(min(limit, most) if limit > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Tables:
    """Tables that one call writes to the shared folder. drop() deletes those that no result needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.release()
        path = new_path(self.spark, name)
        with _small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def release(self) -> None:
        """Shuffle files of tables already written go when the driver collects its garbage; on a small driver that is too late."""
        self.spark._jvm.System.gc()

    def bucketed(self, df: DataFrame, name: str, *columns: str) -> DataFrame:
        """As written(), dealt into as many buckets of columns as there are shuffle partitions, so that a join on them need not shuffle this side."""
        path, table = new_path(self.spark, name), f"sparkwarden_{uuid.uuid4().hex}"
        with _small_batches(self.spark):
            df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(self.spark), *columns).saveAsTable(table)
        out = self.spark.table(table)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables: whatever was made of them must have been written."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1]).getParent()
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def thrifty(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's work: what it freed goes back to the system, where idle Python workers would keep it from other tasks."""

    @functools.wraps(run)
    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class IdFilter:
    """A bitmap over hashed ids of a fixed number of bits, so the size of what is broadcast is bounded whatever the data.

    It has no false negatives: ids outside it are surely absent from the table it was made of. It only lets rows skip
    a shuffle; where the ids outgrow it, more rows take the shuffle and results stay the same.
    """

    BITS = 26

    def __init__(self, table: DataFrame, column: str):
        found = table.select((self._position(column) + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket"))
        self.rows = found.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits"))

    @classmethod
    def _position(cls, column: str):
        return F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - cls.BITS)

    def mark(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with a boolean column: False where the id is surely not in the table. Null ids are not."""
        at = self._position(column)
        df = df.withColumn("_bucket", F.floor(at / 32768) + 1).withColumn("_bit", at % 32768).join(F.broadcast(self.rows), "_bucket", "left")
        byte = F.expr("cast(conv(hex(substring(_bits, cast(1 + _bit div 8 AS int), 1)), 16, 10) AS int)")
        held = F.bit_get(byte, (F.col("_bit") % 8).cast("int")) == 1
        return df.withColumn(name, F.coalesce(held, F.lit(False)) & F.col(column).isNotNull()).drop("_bucket", "_bit", "_bits")
