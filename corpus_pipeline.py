"""A corpus pipeline of five operators; each stage works on all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Null texts go in the first stage; null ids are kept throughout; an empty table stays empty.  A
document is a different (doc_id, text): stages that take documents out go by a key of both, so that texts
which share an id, or have none, are judged each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.bit_tables import parted, without
from pactum.llm.decontaminate import benchmark_overlaps
from pactum.llm.frames import table, written
from pactum.llm.language import identified
from pactum.llm.mixing import mixed_documents
from pactum.llm.ngram_join import near_duplicates
from pactum.llm.sharding import shard_documents

SHARDS = 16
#: Of a document: never null, and alike only for rows equal in id and text.
KEY = "__document"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _as_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    return identified(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest doc_id (a null id being smaller than
    all).  Blank texts are no duplicates."""
    rows = keyed(docs)
    found = near_duplicates(_as_ids(rows)).where("n_shingles > 0")
    members = found.groupBy(F.col("doc_id").alias(KEY), "component_id").agg(F.count("*").alias("n"))
    members = written(members.join(rows.select(KEY, F.col("doc_id").cast("long")).distinct(), KEY), "pipeline-members")
    stay = members.groupBy("component_id").agg(F.min(F.struct("doc_id", KEY)).alias("first")).select(f"first.{KEY}")
    gone = written(members.select(KEY).join(stay, KEY, "left_anti"), "pipeline-gone")
    cleared, unsure = parted(rows, gone.unionByName(members.where("n > 1").select(KEY)), KEY)
    wordy = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # one of equal rows, before the join: tasks send one row a key
    once = unsure.where(wordy).dropDuplicates([KEY]).join(gone, KEY, "left_anti")
    return cleared.unionByName(unsure.where(~wordy)).unionByName(once).drop(KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    rows = keyed(docs)
    found = benchmark_overlaps(_as_ids(rows), table(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("doc_id").alias(KEY)), KEY).drop(KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands in the mix as often as its rate says."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its slot there."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Trained models and hash orders can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
