"""Small helpers shared by the operators: tables, Arrow chunks, checkpoints, unused names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that numpy works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="pactum-llm-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once below the shared folder and read back: later uses don't compute them again."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text as long and string, and the named columns; other columns are left out."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *columns)


def held_out_remainder(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """(first row, last row, bytes, offsets) of runs of rows, without copying the text.

    Offsets start at 0 and have one entry more than rows; a null text is an empty one.
    """
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
        if (sizes != np.diff(offsets)).any():
            texts = texts.fill_null("")
            yield from text_chunks(pa.RecordBatch.from_arrays([texts], [column]), column, limit)
            return
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """The ids as numpy longs; a null id is the smallest long, which `restored` turns back."""
    return batch.column(column).fill_null(NO_ID).to_numpy(zero_copy_only=False)


NO_ID = -(1 << 63)


def restored(name: str = "doc_id"):
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
