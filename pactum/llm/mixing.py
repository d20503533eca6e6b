"""Mixing sources to target weights by soft membership, with DataFrame operations alone.

1. A naive Bayes classifier is counted from a bounded sample of the labelled table: words and coarse
   measures of a text give it posteriors for the domains `high`, `low` and `toxic`.
2. Every document has a nonnegative rate.  With posteriors p and tokens t, domain d is expected to get
   ``S_d = sum(rate * t * p_d)``.  Projected-gradient least squares moves the rates, from 1, until S meets
   the target totals: ``rate <- max(0, rate - p . G^-1 (S - target))`` with ``G = sum(t * p * p')``, which is
   a unit step on the squared distance measured by G^-1, tokens being the metric of the rates.
3. Rates become whole copies, ``floor(rate + u)`` with u a hash of the document's id and text.

An iteration is one sum over the documents; the driver holds only the domains' totals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.frames import written

DOMAINS = ("high", "low", "toxic")
#: Shares of all tokens that the mix is to have; toxic text is to have next to none.
TARGETS = {"high": 0.86, "low": 0.135, "toxic": 0.005}
#: Bounds of the classifier: labelled documents of each domain, and words that it knows.
SAMPLE_DOCS, KNOWN_WORDS = 1500, 64
#: A word marks a domain from this value of chi-square and this ratio of its share to the others' on.
SIGNIFICANT, LIFT = 25.0, 5.0
STEPS, CLOSE = 12, 1e-6
#: Coarse measures, each in bins 0 to 9.
MEASURES = ("upper", "marks", "distinct", "length")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    """The word in lower case without the usual marks around it."""
    return F.lower(F.btrim(word, F.lit(".,;:!?()[]\"'*|%&$#-")))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each different word of each document, with what only whole texts tell."""
    listed = docs.select(*keep, _words(F.coalesce(F.col("text"), F.lit(""))).alias("__w"))
    once = listed.select(*keep, F.size("__w").alias("n"), F.array_distinct("__w").alias("__w"))
    return once.select(*keep, "n", F.size("__w").alias("nd"), F.posexplode_outer("__w").alias("__at", "__w"))


def _rows() -> Column:
    """Of a group of measured rows: documents in it, each having one first row."""
    return F.sum((F.coalesce("__at", F.lit(0)) == 0).cast("long"))


def _sums() -> list[Column]:
    """Measures of a group of equal documents, as of one of them."""
    w, n = F.col("__w"), _rows()
    return [
        F.max("n").alias("n_tokens"), F.max("nd").alias("n_distinct"),
        (F.sum(((w == F.upper(w)) & (w != F.lower(w))).cast("int")) / n).alias("n_upper"),
        (F.sum((_bare(w) != F.lower(w)).cast("int")) / n).alias("n_marks"),
        (F.sum(F.length(w)) / n).alias("n_chars"),
    ]


def _bins() -> dict[str, Column]:
    d = F.greatest(F.col("n_distinct"), F.lit(1))
    tenth = {
        "upper": F.col("n_upper") / d, "marks": F.col("n_marks") / d,
        "distinct": d / F.greatest(F.col("n_tokens"), F.lit(1)), "length": F.col("n_chars") / d / 20,
    }
    return {name: F.least(F.lit(9), F.floor(F.coalesce(tenth[name], F.lit(0.0)) * 10)).cast("int") for name in MEASURES}


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)


class Classifier:
    """Log weights: prior by domain, words by domain, measure bins by domain."""

    def __init__(self, prior: list[float], words: dict[str, list[float]], bins: dict[str, list[list[float]]]):
        self.prior, self.words, self.bins = prior, words, bins


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, known: int = KNOWN_WORDS) -> Classifier:
    """Counts from at most `sample` labelled documents of each domain, chosen by a hash of their id.

    A label without a document, a document without a label, and nulls in either label column teach
    nothing; an id labelled twice counts as often, rows equal in id and text teach once.  Without any labels
    the posteriors are even.
    """
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), _domain().alias("domain"))
        .withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    )
    # at most 3 * sample rows of two numbers: its size is bounded by parameters
    met = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("hash")).join(F.broadcast(chosen), "doc_id")
    label = ("domain", "k", "hash")
    taught = written(met.dropDuplicates(label), "mix-sample")
    rows = _measured(taught.where("text IS NOT NULL"), *label)
    of = [F.sum((F.col("domain") == d).cast("int")).alias(f"c{d}") for d in range(3)]
    sizes = [int(x or 0) for x in taught.where("text IS NOT NULL").agg(*of).first()]
    total = max(1, sum(sizes))
    # documents of each domain that have the word
    counts = rows.select(*label, _bare(F.col("__w")).alias("w")).where("w <> ''").distinct().groupBy("w").agg(*of)
    share = [(F.col(f"c{d}") + 0.5) / (sizes[d] + 1.0) for d in range(3)]
    rest = [(sum((F.col(f"c{e}") for e in range(3) if e != d), F.lit(0.5))) / (total - sizes[d] + 1.0) for d in range(3)]
    both = (F.col("c0") + F.col("c1") + F.col("c2") + 1.0) / (total + 2.0)
    chi = [(share[d] - rest[d]) ** 2 / (both * (1 - both)) / (1.0 / (sizes[d] + 1) + 1.0 / (total - sizes[d] + 1)) for d in range(3)]
    marks = [(chi[d] >= SIGNIFICANT) & (share[d] >= LIFT * rest[d]) for d in range(3)]
    marked = marks[0] | marks[1] | marks[2]
    there = [F.when(chi[d] >= SIGNIFICANT, F.ln(share[d] / rest[d])).otherwise(0.0).alias(f"l{d}") for d in range(3)]
    absent = [F.when(chi[d] >= SIGNIFICANT, F.ln((1 - share[d]) / (1 - rest[d]))).otherwise(0.0).alias(f"a{d}") for d in range(3)]
    top = counts.select("w", *there, *absent, F.greatest(*chi).alias("chi"), marked.alias("marked")).where("marked").orderBy(F.desc("chi"), "w").limit(known).collect()
    words = {r["w"]: [r[f"l{d}"] - r[f"a{d}"] for d in range(3)] for r in top}
    texts = rows.groupBy(*label).agg(*_sums())
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), b.alias("b")) for m, b in _bins().items()]))
    bins = {m: [[math.log(0.5 / (s + 5.0)) for s in sizes] for _ in range(10)] for m in MEASURES}
    for r in texts.select("domain", entries.alias("e")).groupBy("e.m", "e.b").agg(*of).collect():
        bins[r["m"]][r["b"]] = [math.log((r[f"c{d}"] + 0.5) / (sizes[d] + 5.0)) for d in range(3)]
    # domains are sampled evenly; their true shares are counted from all labels
    shares = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(_domain().alias("domain")).agg(*of).first()
    shares = [int(x or 0) for x in shares]
    # what a text without any known word starts from
    prior = [math.log((x + 1) / (sum(shares) + 3)) + sum(r[f"a{d}"] for r in top) for d, x in enumerate(shares)]
    return Classifier(prior, words, bins)


def posteriors(docs: DataFrame, model: Classifier, *keys: str) -> DataFrame:
    """The keys, n_rows, n_tokens and p_high, p_low, p_toxic; the n_rows rows alike in all keys, which must
    have one text, become one and are judged as one."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(w, *v) for w, v in model.words.items()], "w string, w0 double, w1 double, w2 double")
    rows = _measured(docs, *keys).withColumn("w", _bare(F.col("__w"))).join(F.broadcast(table), "w", "left")
    summed = rows.groupBy(*keys).agg(*_sums(), _rows().alias("n_rows"), *[F.coalesce(F.sum(f"w{d}") / _rows(), F.lit(0.0)).alias(f"s{d}") for d in range(3)])
    summed = summed.select(*keys, "n_rows", F.greatest("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "s0", "s1", "s2", *[b.alias(f"b_{m}") for m, b in _bins().items()])
    logits = []
    for d in range(3):
        x = F.lit(model.prior[d]) + F.col(f"s{d}")
        for m in MEASURES:
            x = x + F.element_at(F.array(*[F.lit(v[d]) for v in model.bins[m]]), F.col(f"b_{m}") + 1)
        logits.append(x.alias(f"x{d}"))
    # one over the sum of the others' odds: no column is used more than a few times
    odds = summed.select(*keys, "n_rows", "n_tokens", *logits)
    return odds.select(*keys, "n_rows", "n_tokens", *[
        (1 / sum((F.exp(F.col(f"x{e}") - F.col(f"x{d}")) for e in range(3)), F.lit(0.0))).alias(f"p_{name}") for d, name in enumerate(DOMAINS)])


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps whose G^-1 (S - target) is given."""
    rate = F.lit(1.0)
    if not history:
        return rate
    steps = F.array(*[F.struct(*[F.lit(float(x)).alias(f"x{d}") for d, x in enumerate(step)]) for step in history])
    return F.aggregate(steps, rate, lambda r, s: F.greatest(
        F.lit(0.0), r - sum((F.col(f"p_{name}") * s[f"x{d}"] for d, name in enumerate(DOMAINS)), F.lit(0.0))))


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = STEPS) -> tuple[Column, list[float]]:
    """(rate as an expression over the posteriors, expected share of each domain after the last step)."""
    p = [F.col(f"p_{name}") for name in DOMAINS]
    t = F.col("n_tokens")
    first = members.agg(F.sum(t).alias("t"), *[F.sum(t * p[a] * p[b]).alias(f"g{a}{b}") for a in range(3) for b in range(a, 3)]).first()
    total = float(first["t"] or 0)
    if not total:
        return _rate([]), [0.0] * 3
    g = np.array([[first[f"g{min(a, b)}{max(a, b)}"] or 0.0 for b in range(3)] for a in range(3)])
    inverse = np.linalg.pinv(g, rcond=1e-9, hermitian=True)
    wanted = np.array([targets.get(name, 0.0) * total for name in DOMAINS])
    history: list[list[float]] = []
    while True:
        now = members.withColumn("rate", _rate(history)).agg(*[F.sum(t * x * F.col("rate")).alias(f"s{d}") for d, x in enumerate(p)]).first()
        s = np.array([float(x or 0) for x in now])
        if len(history) >= steps or np.abs(s - wanted).max() <= CLOSE * total:
            return _rate(history), list(s / total)
        history.append(list(inverse @ (s - wanted)))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """doc_id, text_hash, n_tokens, p_high, p_low, p_toxic, rate, copies: one row for each different doc_id
    and text.

    * n_tokens counts words between white space; a null or empty text has none, weighs nothing and gets
      its rate like any other.  A null id is kept.
    * Equal texts have equal posteriors and rates, copies may differ by one.  A row that stands k times is
      judged as one, weighs k times in the mix and gets its copies k times there.
    * Targets that can't be met (a domain without documents) are met as near as the rates allow.
    * Columns other than doc_id and text are left out; no documents give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    members = written(posteriors(texts, fit(docs, labels), "doc_id", "text_hash"), "mix-members")
    rate, _ = fit_rates(members.withColumn("n_tokens", F.col("n_tokens") * F.col("n_rows")), targets)
    luck = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit("mix")), 11) + 0.5) / float(1 << 53)
    return members.drop("n_rows").withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + luck).cast("int"))


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as its copies say.  Documents of copies 1,
    most of them, are never moved by name: only ids and copies are joined to them."""
    rates = mixing_rates(docs, labels, targets).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copies")
    # a null id meets only itself
    met = docs.withColumn("__h", text_hash()).join(
        rates, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    return met.where("copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
