"""The training corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases: a document whose text is null or empty fails the base rules of the first stage and goes. Of rows that share
an id and a text one stays; of rows that share only the id, all that are no copies stay. Texts are taken whole, of any
length; empty tables give empty results. A row with a null id is linked with nothing and loses no passage. Columns of docs
come back with their own values, whatever their names; a text that lost a passage has a new n_chars, if docs has that column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from sparkwarden.llm.shared import IdFilter, new_path, written

#: The decision list is learned from labels, so SQL alone cannot give these rows.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a mark before each column's name, so that no operator's column has the same."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_c_{c}") for c in docs.columns))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`_c_{c}`").alias(c) for c in docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone names by (doc_id, tag), tag being the text's CRC-32. Only rows that may be gone are shuffled."""
    rows = IdFilter(gone, "doc_id").mark(docs, "doc_id", "_maybe")
    maybe = rows.filter("_maybe").withColumn("_tag", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("tag").alias("_gone_tag"))
    left = maybe.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_tag") == F.col("_gone_tag")), "left_anti")
    return rows.filter("NOT _maybe").select(docs.columns).unionByName(left.select(docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rules = quality_rules.learn(quality_rules.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _named(quality_rules.judged(_numbered(docs), rules, "_c_text").filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.75 or more connect: the one with the smallest id."""
    groups = written(jaccard_join.similar_documents(docs.select("doc_id", "text")), "groups").filter("doc_id IS NOT NULL")
    several = groups.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("component_id"))
    left = _without(docs, several.filter("component_id <> doc_id").select("doc_id", "tag"))
    again = several.filter("n > 1 AND component_id = doc_id").select("doc_id", "tag")
    once = IdFilter(again, "doc_id").mark(left, "doc_id", "_maybe")
    single = once.filter("_maybe").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return once.filter("NOT _maybe").select(docs.columns).unionByName(single)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in 50-word windows that an earlier document has. Texts that lose none stay as they are."""
    out = substring_dedup.remove_repeated_windows(_numbered(docs), "_c_doc_id", "_c_text")
    cut = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("_c_n_chars", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("_c_n_chars")))
    return _named(out.withColumn("_c_text", F.when(cut, F.col("kept_text")).otherwise(F.col("_c_text"))), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontamination.contamination(docs.select("doc_id", "text").withColumn("doc_id", F.xxhash64("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.filter("contaminated").select("doc_id"), "contaminated")
    keyed = IdFilter(gone, "doc_id").mark(docs.withColumn("_key", F.xxhash64("doc_id", "text")), "_key", "_maybe")
    left = keyed.filter("_maybe").join(gone.select(F.col("doc_id").alias("_key")), "_key", "left_anti")
    return keyed.filter("NOT _maybe").select(docs.columns).unionByName(left.select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage_{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
