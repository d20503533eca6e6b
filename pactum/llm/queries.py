"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactum.llm import centroids, merkle, oracles
from pactum.llm.frames import table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.repeated_bytes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pactum.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.surrogates import replace_private

    # whoever knows the key can look surrogates up: a deployment sets its own
    return replace_private(table(spark, sf_dir, "documents"), spark.conf.get("spark.pactum.surrogateKey", "surrogates"))


def op8_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.decontaminate import benchmark_overlaps

    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.topk_search import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), 20)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pactum.llm.centroids import cluster_report

    return cluster_report(table(spark, sf_dir, "embeddings"))


def op12_byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pactum.llm.byte_pairs import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing_rates": op1_mixing_rates,
    "op2_ngram_join": op2_ngram_join,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_model_scores": op4_model_scores,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_private_data": op7_private_data,
    "op8_benchmark_overlaps": op8_benchmark_overlaps,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_byte_pair_round_trip": op12_byte_pair_round_trip,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.NGRAM_JOIN,
    "op3_repeated_bytes": oracles.REPEATED_BYTES,
    "op10_exact_top_k": oracles.TOP_K,
    "op11_centroid_clusters": centroids.oracle_sql(),
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
