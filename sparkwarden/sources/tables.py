"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the folder that spark.checkpoint.dir names, and reads it back: several readers share one computation.

    by: a column of few values whose rows are kept apart, so that a reader of one value reads no others.
    """
    spark = df.sparkSession
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sparkwarden-")
    path = f"{root.rstrip('/')}/sparkwarden-{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
