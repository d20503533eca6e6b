"""Policy passages: cut documents into pieces, rank vectors, attach excerpts to reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum import fixed

MAX_QUERIES = 256


def chunk_documents(documents: DataFrame, source: str, text: str, size: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Consecutive pieces of ``size`` characters covering the whole text; none for empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.expr(f"(length(`{text}`) - 1) div {size}")))
    pieces = documents.select(F.col(source).cast("string").alias("source"), F.col(text).alias("__text"),
                              F.explode(starts).alias("n"))
    return pieces.select(
        F.concat("source", F.lit("::"), F.col("n").cast("string")).alias("chunk_id"), "source",
        F.col("n").cast("int").alias("chunk_index"),
        F.substring(F.col("__text"), (F.col("n") * size + 1).cast("int"), F.lit(size)).alias("text"),
    )


def collect_queries(queries: DataFrame, limit: int = MAX_QUERIES) -> list[tuple]:
    """(query_id, vector) pairs for ``knn_topk``; more than ``limit`` is an error, never a cut."""
    rows = queries.select("query_id", "vector").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} query vectors; search them in groups")
    return sorted((row["query_id"], [float(x) for x in row["vector"]]) for row in rows)


def knn_topk(vectors: DataFrame, key: str, vector: str, queries: list[tuple], k: int = fixed.TOP_K) -> DataFrame:
    """The ``k`` nearest vectors of each query by squared Euclidean distance, ties by key.

    The vectors are scanned once, in Arrow batches, and never shuffled: each batch passes on its k
    best rows per query, ``row_number() <= k`` prunes those again inside the task, and only k
    rows per query and task move on.  The distances of a batch are one array operation per query,
    which measured several times faster than the same sum as a column expression.
    """
    if not queries:
        key_type = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id string, rank int, vec_id {key_type}, distance double")
    names = [query for query, _ in queries]
    points = np.array([point for _, point in queries], dtype="float64")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            keys = batch["vec_id"].to_numpy()
            matrix = np.stack(batch["vector"].to_numpy()).astype("float64")
            for name, point in zip(names, points):
                distance = ((matrix - point) ** 2).sum(axis=1)
                best = np.lexsort((keys, distance))[:k]
                yield pd.DataFrame({"query_id": name, "vec_id": keys[best], "distance": distance[best]})

    key_type = vectors.schema[key].dataType.simpleString()
    query_type = "string" if isinstance(names[0], str) else "bigint"
    found = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")).filter(
        F.col("vector").isNotNull()
    ).mapInPandas(nearest, f"query_id {query_type}, vec_id {key_type}, distance double")
    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    top = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "distance")


# -- any number of queries -----------------------------------------------------------------------

#: Vectors that cells form around, and vectors and queries of one block, on average.
PIVOTS, BLOCK_VECTORS, BLOCK_QUERIES = 64, 8192, 4096


def _to_pivots(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((matrix[:, None] - pivots[None]) ** 2).sum(axis=2), 0))


def _nearest_of(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block, without those surely beyond its ``kth``.

    Distances are first taken from one matrix product, which is off by rounding; rows that may be among the k
    nearest get theirs from the differences, as a plain search would.
    """
    empty = pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "vec_id": rows["vec_id"].iloc[:0], "distance": np.empty(0)})
    if asked.empty or rows.empty:
        return empty
    keys, m = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype("float64")
    q = np.stack(asked["vector"].to_numpy()).astype("float64")
    m_norm, q_norm = (m**2).sum(axis=1), (q**2).sum(axis=1)
    found = []
    for start in range(0, len(q), 256):
        part = slice(start, start + 256)
        rough = q_norm[part, None] + m_norm[None] - 2 * (q[part] @ m.T)
        slack = 1e-9 * (q_norm[part] + m_norm.max()) + 1e-12
        most = np.partition(rough, k - 1, axis=1)[:, k - 1] if k <= len(m) else np.full(len(rough), np.inf)
        most = np.fmin(most, asked["kth"].to_numpy(dtype="float64")[part]) + slack  # a null kth bounds nothing
        for n, (row, bound) in enumerate(zip(rough, most), start):
            near = np.flatnonzero(row <= bound)
            if not len(near):
                continue
            distance = ((m[near] - q[n]) ** 2).sum(axis=1)
            best = np.lexsort((keys[near], distance))[:k]
            found.append(pd.DataFrame({"query_id": asked["query_id"].iloc[n], "vec_id": keys[near][best], "distance": distance[best]}))
    return pd.concat(found) if found else empty


def knn_join(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """The ``k`` nearest vectors of every query (query_id, vector) by squared Euclidean distance, ties by key.

    Vectors form cells around PIVOTS of their own, dealt into blocks of some BLOCK_VECTORS.  A query first searches
    its own cell, which gives it a k-th distance; then only those cells that the triangle inequality leaves: a
    cell's vectors are at least ``d(query, pivot) - radius`` away, and at least ``inner radius - d(query, pivot)``.
    Only (query, cell) pairs that remain are joined, in blocks, and each is one matrix product in a task.

    Null vectors, and vectors of another length than the pivots', are left out; so are queries like that.  No
    vectors or no queries give no rows.  Besides the pivots and a line a cell, nothing comes to the driver.
    """
    spark = vectors.sparkSession
    key_type, query_type = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("vector").collect()
    schema = f"query_id {query_type}, rank int, vec_id {key_type}, distance double"
    if not chosen:
        return spark.createDataFrame([], schema)
    dims = len(chosen[0]["vector"])
    pivots = np.array([r["vector"] for r in chosen if len(r["vector"]) == dims], dtype="float64")
    # a plain array: null and non-finite components have no distance
    sound = (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.coalesce(sound, F.lit(False)))

    def in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024].copy()
                away = _to_pivots(np.stack(part["vector"].to_numpy()), pivots)
                part["cell"], part["away"] = away.argmin(axis=1).astype("int32"), away.min(axis=1)
                yield part

    def with_distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024].copy()
                away = _to_pivots(np.stack(part["vector"].to_numpy()), pivots)
                part["own"], part["to_pivots"] = away.argmin(axis=1).astype("int32"), list(away)
                yield part

    placed = rows.filter(F.coalesce(sound, F.lit(False))).mapInPandas(in_cells, f"vec_id {key_type}, vector array<double>, cell int, away double")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")).collect()  # PIVOTS rows
    if not cells:
        return spark.createDataFrame([], schema)
    blocks = {int(c["cell"]): -(-c["n"] // BLOCK_VECTORS) for c in cells}
    chunks = max(1, -(-asked.count() // BLOCK_QUERIES))
    of_cell = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])
    block = F.pmod(F.xxhash64("vec_id"), F.try_element_at(of_cell, F.col("cell"))).cast("int")
    placed = placed.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.mapInPandas(with_distances, f"query_id {query_type}, vector array<double>, own int, to_pivots array<double>").withColumn(
        "chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))

    def searched(pairs: DataFrame) -> DataFrame:
        """pairs: query_id, vector, kth, chunk, cell."""
        spread = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.try_element_at(of_cell, F.col("cell")) - 1)))
        by = ["chunk", "cell", "block"]
        return spread.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(
            lambda left, right: _nearest_of(left, right, k), f"query_id {query_type}, vec_id {key_type}, distance double")

    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    own = searched(asked.select("query_id", "vector", F.lit(None).cast("double").alias("kth"), "chunk", F.col("own").alias("cell")))
    bounds = own.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    lines = F.array(*[F.struct(F.lit(c["cell"]).alias("cell"), F.lit(c["inner"]).alias("inner"), F.lit(c["outer"]).alias("outer")) for c in cells])
    reach = F.sqrt("kth") * (1 + 1e-9) + 1e-9
    away = F.get("to_pivots", F.col("c.cell"))
    left = asked.join(bounds, "query_id", "left").withColumn("c", F.explode(lines)).filter(
        (F.col("c.cell") != F.col("own")) & (F.col("kth").isNull() | ((away - F.col("c.outer") <= reach) & (F.col("c.inner") - away <= reach))))
    others = searched(left.select("query_id", "vector", "kth", "chunk", "c.cell"))
    return own.unionByName(others).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "distance")


def reference_excerpts(reports: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the passages found for each report's topic.

    ``reports``: dataset, status, topic (and any others, kept); ``hits``: query_id, rank, vec_id,
    distance; ``chunks``: vec_id, source, text.  A passing report gets the names of the sources,
    any other the first characters of each passage.
    """
    found = hits.join(chunks.select("vec_id", "source", "text"), "vec_id")
    excerpt = F.concat(
        F.lit("("), F.col("source"), F.lit(") "),
        F.rtrim(F.substring(F.trim(F.col("text")), 1, fixed.EXCERPT_CHARS)),
    )
    per_topic = found.groupBy(F.col("query_id").alias("topic")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "source", excerpt.alias("excerpt")))).alias("found")
    )
    joined = reports.join(per_topic, "topic", "left")
    sources = F.array_join(F.transform("found", lambda x: F.concat(F.lit("Ref: "), x["source"])), "\n")
    excerpts = F.array_join(
        F.slice(F.transform("found", lambda x: x["excerpt"]), 1, fixed.TOP_K), "\n---\n"
    )
    return joined.withColumn(
        "references", F.when(F.col("status") == fixed.PASS, sources).otherwise(excerpts)
    ).drop("found")
