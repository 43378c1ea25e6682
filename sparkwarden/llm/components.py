"""Connected components by alternating large-star and small-star steps, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b): the smallest node that it is connected with.

    Nodes without links are not in the result. A step holds a row per link; a node's links are never gathered.
    """
    tables = Tables(links.sparkSession)
    edges = tables.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_mins(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        mins = _mins(down)
        small = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = tables.written(small, "stars")
        tables.drop(edges)
        # A node without a smaller neighbour heads a star; all links to heads means done.
        more = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = new
        if not more and not _changes(edges):
            break
    heads = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))


def _changes(edges: DataFrame) -> int:
    """Nodes that hang from two heads: their components still have to meet."""
    return edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a <> b").limit(1).count()
