"""Gate for arriving files: check new rows as they land, before ingestion.

The checks are stateless, so the stream keeps no state; a lost executor costs the re-read of its
files and nothing else.  Each micro-batch is written under its own batch number in overwrite
mode: a batch that is run again after a failure replaces its earlier output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pactum.operators.remediate import with_reasons
from pactum.types import Contract


def arrivals(spark: SparkSession, path: str, schema: T.StructType | str, file_format: str = "csv",
             files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.format(file_format).load(path)


def start_gate(stream: DataFrame, contract: Contract, out: str, checkpoint: str, channel: str = "data-quality") -> StreamingQuery:
    """Write valid and quarantined rows of everything that has arrived, and an alert for each batch with
    quarantined rows, then stop.

    One pass a batch: both verdicts are written as partitions of ``out/rows``, and the batch is counted while it
    is written (an ``Observation``), so nothing is read twice.  Its alert goes below ``out/alerts`` under the
    batch's number, in overwrite mode like the rows: a batch that is run again gives no second alert.
    """
    marked = with_reasons(stream, contract)
    bad = F.size("reasons") > 0
    marked = marked.withColumn("verdict", F.when(bad, F.lit("quarantined")).otherwise(F.lit("valid")))

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(f"gate-{uuid.uuid4().hex}")
        batch.observe(seen, F.count(F.lit(1)).alias("arrived"), F.count_if(F.col("verdict") == "quarantined").alias("rejected")).write.mode(
            "overwrite").partitionBy("verdict").parquet(f"{out}/rows/batch={number}")
        counts = seen.get
        alert = batch.sparkSession.range(1).select(
            F.lit(channel).alias("channel"), F.lit(contract.name).alias("contract"), F.lit(counts["arrived"]).cast("long").alias("arrived"),
            F.lit(counts["rejected"]).cast("long").alias("rejected"))
        alert.filter(F.col("rejected") > 0).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")

    return (
        marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def gated_rows(spark: SparkSession, out: str) -> DataFrame:
    """Everything the gate has written, with its verdict and batch."""
    return spark.read.parquet(f"{out}/rows")


def stream_alerts(spark: SparkSession, out: str) -> DataFrame:
    """One alert per batch that held quarantined rows: channel, contract, batch, arrived, rejected, title, text."""
    found = spark.read.schema("channel string, contract string, arrived long, rejected long, batch long").parquet(f"{out}/alerts")
    return found.select(
        "channel", "contract", "batch", "arrived", "rejected",
        F.concat(F.lit("Rows held back in batch "), F.col("batch").cast("string")).alias("title"),
        F.concat(F.col("rejected").cast("string"), F.lit(" of "), F.col("arrived").cast("string"), F.lit(" rows depart from `"), F.col("contract"), F.lit("`")).alias("text"))
