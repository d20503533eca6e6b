"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard gives every key a score, ``-ln(u) / weight`` with u in (0, 1) from a hash of key and
shard; the lowest score wins.  A shard added to the set can only win rows for itself, and a shard
that is taken away hands out its own rows alone.  No state is kept and no row meets another, so a hot
source or a large group of copies changes nothing: copies have different keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard that one task numbers, and numbering buckets of a shard at least.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 8


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of a key: 0 to len(weights) - 1.  A shard of weight 0 gets nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be nonnegative and one positive")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", key, F.lit(str(shard)))), 11)
            scores.append(F.struct((-F.ln((bits + 0.5) / float(1 << 53)) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return (F.array_min(F.array(*scores)))["shard"]


def shard_documents(
    docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, new_weight: float = 1.0, keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in `keep`.

    * size is the text's UTF-8 bytes plus 1; a null text has size 1 and crc 0, an empty one the same.
    * shard depends on doc_id and the weights only (a null doc_id is a key of its own), so rows with the
      same doc_id go to the same shard; grown_shard is the shard once one more, of `new_weight`, is added.
    * slot numbers a shard's rows from 0 without gaps.  Rows are numbered in hash buckets (of id and text)
      by id, crc and size, and each bucket is moved up by the rows of those before it: no task sees a whole
      shard.  Rows that are alike in all of these get slots in any order.
    * No rows give no rows.  Columns of the input other than doc_id, text and `keep` are left out; a name in
      `keep` that is also a result column is refused.
    """
    weights = list(weights) if weights else [1.0] * shards
    made = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if clash := [c for c in keep if c in made and c != "doc_id"]:
        raise ValueError(f"columns {clash} clash with the result's")
    keep = [c for c in keep if c != "doc_id"]
    buckets = max(LEAST_BUCKETS, docs.count() // (len(weights) * BUCKET_ROWS) + 1)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("string")), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, new_weight]).alias("grown_shard"),
        *[F.struct(*[F.col(c) for c in keep]).alias("__kept")] if keep else [],
    ).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(buckets)))
    sums = keyed.groupBy("shard", "__bucket").count()
    before = sums.select(
        "shard", "__bucket",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("count")).alias("__before"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = keyed.withColumn("__within", within - 1).join(before, ["shard", "__bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
        (F.col("__before") + F.col("__within")).cast("long").alias("slot"), F.col("grown_shard").cast("int"),
        *[F.col(f"__kept.{c}") for c in keep],
    )
