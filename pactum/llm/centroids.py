"""Centroid clustering in exact integers, by equal-average equal-variance search.

With D components, sum S and deviation v (v**2 = sum of squares - S**2 / D), two vectors are at a squared
distance of at least ``(S - S')**2 / D + (v - v')**2``.  Centroids are sorted by their mean.  Each vector
starts where its own mean belongs and goes outward to both sides, nearest mean first: once the first term
alone is above the best distance so far, no centroid further out can win and the vector is done; a centroid
whose two terms are above it is passed over.  What is left gets its distance in exact integers.

Bounds are worked out in doubles with some slack, so they never reject a nearest centroid; distances, sums
and averages are integers throughout.  A round sends one row of sums a centroid and task; the centroids,
a parameter's number of vectors, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.frames import written

#: Rows of vectors that numpy works on at once.
BATCH_ROWS = 4096
#: What a bound gives up of itself, far more than the rounding of doubles.
SLACK = 1e-9


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the vectors with exactly `dims` components, none of them null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), x.alias("embedding"))


def on_grid(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): longs where all later work on them fits into longs, else Python integers."""
    largest = np.abs(x).max(initial=0.0) * scale
    if largest + 1 < (1 << 30) / x.shape[1]:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v * scale // 1) if abs(v) < 1e300 else int(v) * scale for v in row] for row in x.tolist()], object)


def _sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and deviations of rows."""
    total, squares = m.sum(axis=1), (m * m).sum(axis=1)
    return total, np.sqrt((m.shape[1] * squares - total * total).astype(float) / m.shape[1])


class Centroids:
    """Centroids in order of their means, those of equal means by number."""

    def __init__(self, matrix: np.ndarray):
        totals, deviations = _sums(matrix)
        self.number = np.array(sorted(range(len(matrix)), key=lambda k: (totals[k], k)), np.int64)
        self.matrix, self.totals, self.deviations = matrix[self.number], totals[self.number], deviations[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, and the squared distance; ties to the smaller number."""
        n, dims, k = *x.shape, len(self.number)
        totals, deviations = _sums(x)
        best = np.zeros(n, x.dtype)
        limit = np.full(n, np.inf)  # best, as a double
        found = np.full(n, k, np.int64)
        right = np.searchsorted(self.totals, totals)
        left = right - 1
        going = np.arange(n)
        for _ in range(k):
            to_left = np.where(left[going] >= 0, (totals[going] - self.totals[np.maximum(left[going], 0)]).astype(float), np.inf)
            to_right = np.where(right[going] < k, (self.totals[np.minimum(right[going], k - 1)] - totals[going]).astype(float), np.inf)
            leftward = to_left <= to_right
            mean_bound = np.minimum(to_left, to_right) ** 2 / dims * (1 - SLACK)
            near = mean_bound <= limit[going]  # an equal one may be a tie with a smaller number
            going, leftward, mean_bound = going[near], leftward[near], mean_bound[near]
            if not len(going):
                break
            at = np.where(leftward, left[going], right[going])
            left[going] -= leftward
            right[going] += ~leftward
            spread = np.abs(deviations[going] - self.deviations[at]) - SLACK * (deviations[going] + self.deviations[at])
            close = mean_bound + np.maximum(spread, 0) ** 2 * (1 - SLACK) <= limit[going]
            rows, at = going[close], at[close]
            apart = x[rows] - self.matrix[at]
            distance = (apart * apart).sum(axis=1)
            number = self.number[at]
            better = (found[rows] == k) | (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
            rows = rows[better]
            best[rows], found[rows], limit[rows] = distance[better], number[better], distance[better].astype(float)
        return found, best


def _assigned(batch: pa.RecordBatch, matrix: np.ndarray, scale: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors on the grid, clusters, distances) of runs of rows."""
    for start in range(0, batch.num_rows, BATCH_ROWS):
        part = batch.slice(start, BATCH_ROWS)
        x = on_grid(part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1), scale)
        if x.dtype != matrix.dtype:  # one of them needs Python integers
            x, matrix = x.astype(object), matrix.astype(object)
        yield part.column("vec_id"), x, *Centroids(matrix).nearest(x)


def _as_matrix(rows: list[list[int]]) -> np.ndarray:
    largest = max((abs(x) for row in rows for x in row), default=0)
    return np.array(rows, np.int64 if largest + 1 < (1 << 30) / len(rows[0]) else object)


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The grid vectors of the k smallest lowercase-hex sha256 of ``seed:vec_id``, in ascending order.
    Rows of one id are taken in the order of their vectors; rows without an id come last."""
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(by_hash.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return [[int(v) for v in on_grid(np.array([r.embedding]), scale)[0]] for r in rows]


def moved_centroids(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Every non-empty centroid becomes the componentwise floor(sum / count) of the vectors nearest to it."""
    matrix = _as_matrix(centroids)
    k, dims = matrix.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, matrix, scale):
                for c in np.unique(cluster):
                    rows = x[cluster == c]
                    totals[c] += rows.sum(axis=0).astype(object)
                    counts[c] += len(rows)
        some = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([counts[c] for c in some], pa.int64()),
            pa.array([[Decimal(int(v)) for v in totals[c]] for c in some], pa.list_(pa.decimal128(38, 0))),
        ], ["cluster", "n", "totals"])

    sums = kept.mapInArrow(summed, "cluster int, n long, totals array<decimal(38,0)>")
    by_component = sums.select("cluster", "n", F.posexplode("totals").alias("at", "total")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = [list(c) for c in centroids]
    for r in by_component.collect():  # centroids x components
        moved[r.cluster][r.at] = int(r.total) // r.n
    return moved


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    * Kept are vectors of exactly `dims` components, none null or non-finite; others are left out, and so are
      other columns.  Repeated rows and ids count each; rows without an id take part, but are first centroids
      only where rows with one are fewer than k.
    * Fewer than k vectors give as many centroids as vectors; none give no rows.  Ties go to the smaller
      number; an empty centroid stays where it is.
    * Distances beyond a long raise an error.
    """
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, k, seed, scale)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids, scale)
    matrix = _as_matrix(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in _assigned(batch, matrix, scale):
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64()),
                ], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(nearest, schema), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every kept vector.

    Inertia is the sum of squared distances, of a cluster and of all; the digest is that of the final
    centroid's components as decimal integers joined by commas.  Cases as in `cluster_vectors`.
    """
    assigned, centroids = cluster_vectors(vectors, k, rounds, dims, seed, scale)
    assigned = written(assigned, "clusters")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, inertia[c], sum(inertia.values()), centroid_digest(centroids[c])) for c in sorted(inertia)]
    per_cluster = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, scale: int = 64) -> str:
    """The report in DuckDB's SQL, with every distance worked out."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})
)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (
  SELECT r, min(d * {k} + k) % {k} AS k, min(d) AS d FROM (
    SELECT kept.r, c{n}.k, CAST(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept CROSS JOIN c{n}
  ) GROUP BY r
)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS (
  SELECT c{n}.k, coalesce(moved.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT a{n}.k, i, sum(kept.v[i]) AS s, count(*) AS n FROM kept JOIN a{n} USING (r), range(1, {dims + 1}) AS t(i) GROUP BY a{n}.k, i)
    GROUP BY k
  ) AS moved ON moved.k = c{n}.k
)""")
    return "WITH" + ",".join(steps) + f"""
SELECT kept.vec_id, CAST(a{rounds}.k AS INTEGER) AS cluster, a{rounds}.d AS distance,
  CAST(sum(a{rounds}.d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia, CAST(sum(a{rounds}.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.k = a{rounds}.k
"""
