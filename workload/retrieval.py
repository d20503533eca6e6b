"""Document pieces, nearest vectors, excerpts for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import report, retrieve
from workload import inputs, oracle, reports

QUERIES: dict = {}
ORACLES: dict = {}


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunk_documents(inputs.table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES["chunk_documents"] = chunk_documents
ORACLES["chunk_documents"] = """
    SELECT concat(CAST(doc_id AS varchar), '::', CAST(n AS varchar)) AS chunk_id, CAST(doc_id AS varchar) AS source,
      CAST(n AS integer) AS chunk_index, substring(text, n * 1000 + 1, 1000) AS text
    FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1000)) AS n FROM documents
          WHERE length(text) > 0)
"""


def topic_queries(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """One query vector per label: the label's vector with the least id."""
    vectors = inputs.table(spark, sf_dir, "embeddings")
    queries = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return retrieve.collect_queries(queries)


def knn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.knn_topk(
        inputs.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", topic_queries(spark, sf_dir))


QUERIES["knn_topk"] = lambda spark, sf: knn_hits(spark, sf).withColumn("distance", F.round("distance", 4))

oracle.PARTS["topics"] = "SELECT label AS query_id, arg_min(embedding, vec_id) AS vector FROM embeddings GROUP BY label"
oracle.PARTS["hits"] = """
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance
    FROM (SELECT q.query_id, e.vec_id, list_sum(list_transform(generate_series(1, 64),
            lambda i: (CAST(e.embedding[i] AS double) - CAST(q.vector[i] AS double)) ^ 2)) AS distance
          FROM topics q, embeddings e)
    QUALIFY rank <= 3"""
oracle.NEEDS["hits"] = ["topics"]
ORACLES["knn_topk"] = oracle.query(
    "SELECT query_id, rank, vec_id, round(distance, 4) AS distance FROM hits", "hits")


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 5 asks for its five nearest, itself among them."""
    vectors = inputs.table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.knn_join(vectors, "vec_id", "embedding", asked, 5).withColumn("distance", F.round("distance", 4))


QUERIES["knn_join"] = knn_join
ORACLES["knn_join"] = """
    SELECT query_id, CAST(rank AS integer) AS rank, vec_id, round(distance, 4) AS distance FROM (
      SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding),
          lambda p: (CAST(p[1] AS double) - CAST(p[2] AS double)) ^ 2)) AS distance
        FROM embeddings q, embeddings e WHERE q.vec_id % 5 = 0))
    WHERE rank <= 5"""


def reference_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed's report with the passages of its topic; the first piece of document n stands for
    vector n."""
    topics = [q for q, _ in topic_queries(spark, sf_dir)]
    chunks = chunk_documents(spark, sf_dir).filter(F.col("chunk_index") == 0).select(
        F.col("source").cast("long").alias("vec_id"), "source", "text")
    all_reports = reports.fleet_reports(spark, sf_dir)
    number = F.regexp_extract("dataset", r"(\d+)\z", 1).cast("long")
    listed = F.array(*[F.lit(t) for t in topics])
    with_topic = all_reports.select(
        "dataset", "contract", "status", report.query_text().alias("query_text"),
        F.get(listed, (number % len(topics)).cast("int")).alias("topic"))
    return retrieve.reference_excerpts(with_topic, knn_hits(spark, sf_dir), chunks).select(
        "dataset", "contract", "status", "topic", "references", "query_text")


QUERIES["reference_excerpts"] = reference_excerpts
ORACLES["reference_excerpts"] = oracle.query(
    """
    SELECT s.dataset, s.contract, s.status, t.query_id AS topic,
      CASE WHEN s.status = 'PASS' THEN f.sources ELSE f.excerpts END AS references,
      CASE WHEN p.lines IS NULL THEN 'data contract guidelines'
        ELSE concat(p.lines, coalesce(chr(10) || c.lines, '')) END AS query_text
    FROM states s
      JOIN numbered t ON t.n = CAST(regexp_extract(s.dataset, '[0-9]+$') AS bigint) % (SELECT count(*) FROM numbered)
      LEFT JOIN found f ON f.query_id = t.query_id
      LEFT JOIN every_problem p USING (dataset, contract) LEFT JOIN every_plan c USING (dataset, contract)
    """,
    "states", "hits", "problem_lines", "plan_lines",
    numbered="SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS n FROM topics",
    found="""
      SELECT query_id, string_agg(concat('Ref: ', CAST(doc_id AS varchar)), chr(10) ORDER BY rank) AS sources,
        string_agg(concat('(', CAST(doc_id AS varchar), ') ', rtrim(substring(trim(substring(text, 1, 1000)), 1, 400))),
          concat(chr(10), '---', chr(10)) ORDER BY rank) AS excerpts
      FROM hits JOIN documents ON doc_id = vec_id GROUP BY query_id""",
    every_problem="SELECT dataset, contract, string_agg(text, chr(10) ORDER BY ord) AS lines FROM problem_lines GROUP BY dataset, contract",
    every_plan="SELECT dataset, contract, string_agg(text, chr(10) ORDER BY ord) AS lines FROM plan_lines GROUP BY dataset, contract")
