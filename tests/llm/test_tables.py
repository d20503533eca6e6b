"""Sharding, mixing, top-k search, and the pipeline."""

import math
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pactum.llm import topk_search
from pactum.llm.bit_tables import without
from pactum.llm.mixing import fit_rates, mixed_documents, mixing_rates
from pactum.llm.sharding import shard_documents
from tests.llm.conftest import words


def brute_shard(key: str, weights) -> int:
    scores = [(-math.log(((xxhash.xxh64(f"{key}:{s}".encode(), seed=42).intdigest() >> 11) + 0.5) / 2**53) / w, s) for s, w in enumerate(weights) if w]
    return min(scores)[1]


def test_shards_equal_brute_force(docs, nothing):
    rows = shard_documents(docs, 4, keep=["source"]).collect()
    assert Counter((r.doc_id, r.shard, r.grown_shard) for r in rows) == Counter(
        (r.doc_id, brute_shard(str(r.doc_id) if r.doc_id is not None else "null", [1] * 4), brute_shard(str(r.doc_id) if r.doc_id is not None else "null", [1] * 5))
        for r in docs.select("doc_id").collect())
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 4) and r.source == "s" for r in rows)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (40, 41)} == {(1, 0)}
    assert shard_documents(nothing, 4).count() == 0


def test_weighted_shards(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    n = Counter(r.shard for r in shard_documents(df, weights=[1.0, 3.0, 0.0]).collect())
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02


def test_bounds_of_large_scores_are_not_above_them(spark):
    rng = random.Random(9)
    scores = [rng.randrange(1 << 53, 1 << 62) * s for s in (1, -1) for _ in range(300)] + [0, 7, -7, (1 << 53) - 1, (1 << 53) + 1, 1 - (1 << 53)]
    rows = spark.createDataFrame([(s,) for s in scores], "s long").select("s", topk_search._not_above(F.col("s")).alias("d")).collect()
    assert all(int(r.d) <= r.s and (abs(r.s) >= 1 << 53 or r.d == r.s) for r in rows)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk_search, "SEGMENT_ROWS", 60)
    monkeypatch.setattr(topk_search, "CHUNK_QUERIES", 4)
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)]) for k in range(230)]
    rows += [(300 + k, rows[5][1]) for k in range(40)]  # ties
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] * 6), (460, [float("inf")] + [0.0] * 5), (480, [0.5, 0.5]), (481, [0.25, -0.5]), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:20]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk_search.exact_top_k(df, 20).collect()} == want
    assert topk_search.exact_top_k(df.limit(0)).count() == 0


def mixture(spark):
    rows, labels = [], []
    for k in range(300):
        kind = ("fine", "fine", "junk", "rude")[k % 4]
        text = words(k, 30) + (["vilest", "nasty"] if kind == "rude" else [])
        rows.append((k, " ".join(w.upper() + "!!" for w in text) if kind == "junk" else " ".join(text), "x"))
        if k % 3:
            labels.append((k, int(kind != "junk"), int(kind == "rude")))
    rows += [(900, None, "x"), (901, "", "x"), (None, "words", "x"), (0, rows[0][1], "x")]
    labels += [(5000, 1, 0), (None, 1, 0), (7, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_meets_targets(spark, docs, nothing):
    df, labels = mixture(spark)
    rates = mixing_rates(df, labels, {"high": 0.7, "low": 0.28, "toxic": 0.02}).collect()
    assert len(rates) == 303 and all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rates)
    total = sum(r.n_tokens for r in rates)
    share = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rates) / total for d in ("high", "low", "toxic")]
    assert max(abs(a - b) for a, b in zip(share, (0.7, 0.28, 0.02))) < 0.01
    rude = [r for r in rates if r.doc_id is not None and r.doc_id % 4 == 3 and r.doc_id < 300]
    assert sum(r.p_toxic > 0.5 for r in rude) > 0.95 * len(rude)
    mixed = mixed_documents(df, labels, {"high": 0.7, "low": 0.28, "toxic": 0.02})
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies * (2 if r.doc_id == 0 else 1) for r in rates)
    assert mixing_rates(docs, labels.limit(0)).count() == docs.dropDuplicates(["doc_id", "text"]).count()
    assert mixing_rates(nothing, labels).count() == 0


def test_repeated_rows_are_judged_as_one_and_weigh_as_many(spark):
    df, labels = mixture(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    again = [(i, texts[i], "x") for i in (1, 2, 3) for _ in range(60)] + [(7000 + i, texts[i], "x") for i in (1, 2, 3)]
    both = df.unionByName(spark.createDataFrame(again, df.schema)).repartition(5)
    targets = {"high": 0.7, "low": 0.28, "toxic": 0.02}
    rates = {(r.doc_id, r.text_hash): r for r in mixing_rates(both, labels, targets).collect()}
    one = {r.doc_id: r for r in rates.values() if r.doc_id is not None}
    for i in (1, 2, 3):
        assert one[i].n_tokens == one[7000 + i].n_tokens
        assert all(abs(one[i][c] - one[7000 + i][c]) < 1e-9 for c in ("p_high", "p_low", "p_toxic", "rate"))
    rows = both.select("doc_id", F.xxhash64("text").alias("h")).collect()
    weigh = [rates[r.doc_id, r.h] for r in rows]
    total = sum(r.n_tokens for r in weigh)
    share = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in weigh) / total for d in targets]
    assert max(abs(a - b) for a, b in zip(share, targets.values())) < 0.01


def test_rates_stay_nonnegative(spark):
    members = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (10, 0.0, 1.0, 0.0), (30, 0.0, 0.0, 1.0)], "n_tokens long, p_high double, p_low double, p_toxic double")
    rate, share = fit_rates(members, {"high": 0.5, "low": 0.5, "toxic": 0.0})
    assert [round(r[0], 6) for r in members.select(rate).collect()] == [2.5, 2.5, 0.0] and share[2] == 0.0


def test_without(spark, docs):
    gone = spark.createDataFrame([(20,), (60,), (None,), (999,)], "doc_id long")
    kept = without(docs, gone)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in (20, 60))


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.shard for r in rows} <= set(range(16))
    assert docs.columns == corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns
    assert corpus_pipeline.ngram_join(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_judge_texts_without_an_id_and_repeated_rows(spark, tmp_path):
    one, two, item = (" ".join(words(k, 60)) for k in (700, 701, 702))
    rows = [(None, one), (3, one + " tail"), (2, one), (2, one), (None, two), (9, two + " end"), (8, two), (8, " ".join(words(703, 60)))]
    rows += [(11, " ".join(words(704, 60)))] * 3 + [(12, " ")] * 2 + [(None, None)] * 2
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.ngram_join(spark, df, "")
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, one), (None, two), rows[7], rows[8], (12, " "), (12, " "), (None, None), (None, None)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "x " + item), (None, one), (5, item), (5, two), (6, two)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.decontamination(spark, df, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, one), (5, two), (6, two)])


def test_top_k_asks_with_every_row_of_a_query_id(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk_search, "SEGMENT_ROWS", 30)
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(4)]) for k in range(90)]
    rows += [(20, [-x for x in rows[20][1]]), (40, [0.5, 0.5]), (41, [0.25, -0.5]), (42, [-0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = set()
    for q in {i for i, _ in good if i % 20 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), i) for p, v in good if p == q for i, w in good if i != q and len(w) == len(v)]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:20])}
    assert {tuple(r) for r in topk_search.exact_top_k(df, 20).collect()} == want
