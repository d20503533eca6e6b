"""Bit tables of a fixed size: which keys may be in a set.

A table is sent to every task whatever the size of the set.  A key that isn't in the set is let through
now and then, more often the fuller the table; what is let through is then decided by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.frames import NO_ID, ids
from pactum.llm.words import _STEP, mixed

TABLE_BITS = 25
_U = np.uint64


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of the column `key` (64-bit hashes); words of the table come to the driver, at most 2**(TABLE_BITS - 6)."""
    bit = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    rows = keys.select(
        F.shiftrightunsigned(bit, 6).alias("at"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - TABLE_BITS}) & 63 as int))").alias("x"))
    found = rows.groupBy("at").agg(F.bit_or("x").alias("x")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[found.column("at").to_numpy()] = found.column("x").to_numpy().view(np.uint64)
    return table


def hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> _U(64 - TABLE_BITS)
    return (table[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def id_hash(doc: np.ndarray) -> np.ndarray:
    return mixed(doc.view(np.uint64) * _STEP + _U(11))


def hashed_ids(rows: DataFrame) -> DataFrame:
    """The rows' doc_id as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(id_hash(ids(batch)).view(np.int64))], ["key"])

    return rows.select(F.col("doc_id").cast("long")).mapInArrow(run, "key long")


def parted(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `docs` whose long `key` is not among those of `keys`, rows whose key may be: to be joined)."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(hashed_ids(keys.select(F.col(key).alias("doc_id")))))

    def parts(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = hit(table.value, id_hash(batch.column(key).to_numpy())) == wanted
                if mask.any():
                    yield batch.filter(pa.array(mask))

        return docs.mapInArrow(run, docs.schema)

    return parts(False), parts(True)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, with all columns, whose key is not among the (non-null) keys of `gone`.

    Only rows that the table can't clear are moved: about as many as are taken out.
    """
    gone = gone.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    cleared, unsure = parted(keyed, gone, "__key")
    return cleared.unionByName(unsure.join(gone, "__key", "left_anti")).drop("__key")
