"""Whole-table checks and profiles: uniqueness, personal data, column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import pii
from pactum.functions.text import is_blank
from pactum.types import Contract


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once.  Rows with a null in the key are not compared.

    Counted on the map side first: a key held by a third of all rows still sends one row per task.
    """
    present = df.na.drop(subset=keys)
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def pii_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """Personal data found per row; rows without any are left out."""
    found = df.select(key, *[n.alias(f"{kind}s") for kind, n in pii.counts(F.col(column)).items()])
    return found.filter((F.col("emails") > 0) | (F.col("ssns") > 0) | (F.col("phones") > 0))


def pii_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: cells with a value, cells with personal data, and how often each kind occurs.

    One scan; each task sends one row of sums, whatever the number of cells.
    """
    sums = []
    for n, column in enumerate(columns):
        value = F.col(f"`{column}`").cast("string")
        found = pii.counts(value)
        sums += [
            F.count(value).alias(f"{n}_cells"), F.count_if(reduce(lambda a, b: a + b, found.values()) > 0).alias(f"{n}_cells_with_pii"),
            *[F.sum(times).alias(f"{n}_{kind}s") for kind, times in found.items()],
        ]
    names = ["cells", "cells_with_pii", *[f"{kind.name}s" for kind in pii.KINDS]]
    entries = [
        F.struct(F.lit(column).alias("column"), *[F.coalesce(F.col(f"`{n}_{name}`"), F.lit(0)).cast("long").alias(name) for name in names])
        for n, column in enumerate(columns)
    ]
    return df.agg(*sums).select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def pii_review(df: DataFrame, contract: Contract, dataset: Column) -> DataFrame:
    """What the contract says about personal data, beside what is in its columns.

    ``verdict``: ``declared`` (flagged, and there is some), ``undeclared`` (not flagged, and there is some; to be
    flagged or cleaned before the data goes on), ``unseen`` (flagged, but of no kind that is known), ``none``.
    Contract columns that the data doesn't have are left out.
    """
    received = {f.lower(): f for f in df.columns}
    rules = {received[r.column.lower()]: r for r in contract.rules if r.column.lower() in received}
    flagged = F.col("column").isin([name for name, rule in rules.items() if rule.pii])
    there = F.col("cells_with_pii") > 0
    verdict = (
        F.when(flagged & there, F.lit("declared")).when(there, F.lit("undeclared"))
        .when(flagged, F.lit("unseen")).otherwise(F.lit("none"))
    )
    return pii_by_column(df, list(rules)).select(
        dataset.alias("dataset"), F.lit(contract.name).alias("contract"), "*", flagged.alias("flagged"), verdict.alias("verdict"))


def profile_columns(df: DataFrame, columns: list[str], keys: list[str] = (), exact: bool = True) -> DataFrame:
    """Rows, blanks, distinct values, least and greatest text of each column.

    Exact mode groups by (column, value) first, so that equal values are combined before the
    shuffle and a frequent value is a single row; the second step works on distinct values.
    Otherwise distinct values are estimated with a sketch in one step.
    """
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    cells = texts.unpivot(list(keys), list(columns), "column", "value")
    filled = ~is_blank(F.col("value"))
    by = [*keys, "column"]
    if not exact:
        return cells.groupBy(*by).agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(~filled).alias("blank_count"),
            F.approx_count_distinct(F.when(filled, F.col("value"))).alias("distinct_count"),
            F.min(F.when(filled, F.col("value"))).alias("min_value"),
            F.max(F.when(filled, F.col("value"))).alias("max_value"),
        )
    distinct = cells.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(*by).agg(
        F.sum("n").alias("row_count"), F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("blank_count"),
        F.count_if(filled).alias("distinct_count"),
        F.min(F.when(filled, F.col("value"))).alias("min_value"),
        F.max(F.when(filled, F.col("value"))).alias("max_value"),
    )


# -- profiles that add up ------------------------------------------------------------------------

#: Base-2 logarithm of the registers of a distinct-value sketch: its standard error is 1.04 / sqrt(4096), 1.6 %.
DISTINCT_BITS = 12
#: Accuracy of a quantile sketch: ranks are off by 1.33 % at most, with 99 % confidence.
QUANTILE_K = 200


def profile_sketches(df: DataFrame, columns: list[str], by: list[Column | str] = ()) -> DataFrame:
    """Mergeable profiles: a row for each group (a file, a day, a feed) and column, to be stored and added up by
    ``merge_profiles``.

    Columns: ``by``, column, row_count, blank_count, min_value, max_value, and two sketches, of distinct values and
    of the values that are numbers.  One scan; a task sends one row a group, and no value leaves it.
    """
    names = [f"__{n}" for n in range(len(columns))]
    cells = df.select(*by, *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(columns, names)])
    groups = [c for c in cells.columns if c not in names]
    sums = []
    for n in names:
        filled = F.when(~is_blank(F.col(n)), F.col(n))
        number = filled.try_cast("double")
        sums += [
            F.count(F.lit(1)).alias(f"{n}_row_count"), F.count(filled).alias(f"{n}_filled"),
            F.min(filled).alias(f"{n}_min_value"), F.max(filled).alias(f"{n}_max_value"),
            F.hll_sketch_agg(filled, F.lit(DISTINCT_BITS)).alias(f"{n}_distinct"),
            F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(QUANTILE_K)).alias(f"{n}_numbers"),
        ]
    wide = cells.groupBy(*groups).agg(*sums)
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{n}_row_count").alias("row_count"), (F.col(f"{n}_row_count") - F.col(f"{n}_filled")).alias("blank_count"),
            *[F.col(f"{n}_{part}").alias(part) for part in ("min_value", "max_value", "distinct", "numbers")])
        for c, n in zip(columns, names)
    ]
    return wide.select(*groups, F.explode(F.array(*entries)).alias("c")).select(*groups, "c.*")


def merge_profiles(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Profiles of ``profile_sketches`` added up by column (and ``keys``): a day's files, a table's days."""
    return sketches.groupBy(*keys, "column").agg(
        F.sum("row_count").alias("row_count"), F.sum("blank_count").alias("blank_count"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("numbers").alias("numbers"))


def read_profiles(sketches: DataFrame, quantiles: list[float] = (0.5, 0.95)) -> DataFrame:
    """What stored or merged profiles say: counts, least and greatest text, an estimate of the distinct values, and
    of quantiles of the values that are numbers (``q50``, ...; null where none is)."""
    some = F.kll_sketch_get_n_double("numbers") > 0
    values = [
        F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("numbers")), F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    kept = [c for c in sketches.columns if c not in ("distinct", "numbers")]
    return sketches.select(*kept, F.hll_sketch_estimate("distinct").alias("distinct_count"), *values)
