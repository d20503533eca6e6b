"""Compare received schemas with contracts, for whole fleets of datasets at once.

Inputs: ``assignments`` (dataset, contract), ``rules`` (``contract_rules``) and ``received``
(``columns_meta``).  Everything is keyed by (dataset, contract, lower-cased column): a dataset is judged
under each of its contracts by itself, and one with very many columns spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions import names
from pactum.operators import catalog


def expected_columns(assignments: DataFrame, rules: DataFrame) -> DataFrame:
    """Contract columns of every dataset.  The rules are declared documents, few and small, and are sent to
    every task; a fleet has few contracts, so a join keyed by contract alone would put all of a contract's
    datasets in one task, and the optimizer, which can't size rules made in code, would send the fleet."""
    wanted = rules.select(
        "contract", F.col("pos").alias("exp_pos"), F.col("column").alias("exp_column"),
        F.col("type").alias("exp_type"), names.type_form(F.col("type")).alias("exp_norm"),
        F.coalesce("required", F.lit(False)).alias("exp_required"),
    )
    return assignments.select("dataset", "contract").join(F.broadcast(wanted), "contract").withColumn(
        "key", names.match_key(F.col("exp_column"))
    )


def received_columns(received: DataFrame) -> DataFrame:
    return received.select(
        "dataset", F.col("pos").alias("src_pos"), F.col("column").alias("src_column"),
        F.col("type").alias("src_type"), names.type_form(F.col("type")).alias("src_norm"), names.match_key(F.col("column")).alias("key"),
    )


def aligned(assignments: DataFrame, rules: DataFrame, received: DataFrame) -> DataFrame:
    """Contract and received columns side by side: matched, only expected, or only received.

    Received columns stand once under each contract of their dataset; datasets without a contract
    drop out.  Of received names that differ only in case the last one is matched; the window has the join's
    keys, so it needs no shuffle of its own.
    """
    # both sides grow with the fleet: a shuffle by dataset, never one side sent whole to every task
    judged = received_columns(received).join(assignments.select("dataset", "contract").hint("merge"), "dataset")
    both = expected_columns(assignments, rules).join(judged, ["dataset", "contract", "key"], "full_outer")
    last = F.max("src_pos").over(Window.partitionBy("dataset", "contract", "key"))
    return both.withColumn("__last", last).filter(
        F.col("exp_pos").isNull() | F.col("src_pos").isNull() | (F.col("src_pos") == F.col("__last"))).drop("__last")


def matched_columns(assignments: DataFrame, rules: DataFrame, received: DataFrame) -> DataFrame:
    return aligned(assignments, rules, received).filter(F.col("exp_pos").isNotNull() & F.col("src_pos").isNotNull()).select(
        "dataset", "contract", "exp_pos", "exp_column", "exp_type", "exp_norm", "src_pos", "src_column", "src_type",
        "src_norm",
    )


def _scope(align: DataFrame) -> list[str]:
    """What one comparison is keyed by; an alignment under one contract may leave that column out."""
    return [c for c in ("dataset", "contract") if c in align.columns]


def _with_sizes(forms: DataFrame, others: DataFrame) -> DataFrame:
    """Names with the anchor sizes that occur among the other side's names: at most one of each size."""
    sizes = others.groupBy("contract").agg(F.collect_set(names.anchor_size(F.col("form"))).alias("sizes"))
    return forms.join(sizes, "contract")


def similar_names(wanted: DataFrame, received: DataFrame) -> DataFrame:
    """Different (contract, exp_form, src_form) with similar name forms.

    Both inputs hold different (contract, form).  A fleet repeats few names many times, so names are compared
    once and not once a dataset.  Candidates come from an equi-join on shared keys, never from all pairs.
    """
    left = _with_sizes(wanted, received).select(
        "contract", F.col("form").alias("exp_form"), F.explode(names.expected_keys("form", F.col("sizes"))).alias("block"))
    right = _with_sizes(received, wanted).select(
        "contract", F.col("form").alias("src_form"), F.explode(names.received_keys("form", F.col("sizes"))).alias("block"))
    return left.join(right, ["contract", "block"]).filter(
        names.is_similar(F.col("exp_form"), F.col("src_form"))).select("contract", "exp_form", "src_form").distinct()


def similar_columns(align: DataFrame) -> DataFrame:
    """Pairs (missing contract column, undeclared received column) that look like a rename.

    A received column meets the contract's similar names first, of which there are few, and then the missing
    columns of its own dataset.
    """
    scope = _scope(align)
    side = align if "contract" in scope else align.withColumn("contract", F.lit(""))
    missing = side.filter(F.col("src_pos").isNull()).select(
        "dataset", "contract", "exp_pos", "exp_column", F.col("key").alias("exp_key"), names.name_form(F.col("exp_column")).alias("exp_form"))
    extra = side.filter(F.col("exp_pos").isNull()).select(
        "dataset", "contract", "src_pos", "src_column", F.col("key").alias("src_key"), names.name_form(F.col("src_column")).alias("src_form"))
    forms = [
        rows.select("contract", F.col(form).alias("form")).filter(F.col("form") != "").distinct()
        for rows, form in ((missing, "exp_form"), (extra, "src_form"))
    ]
    found = extra.join(similar_names(*forms), ["contract", "src_form"]).join(missing, ["dataset", "contract", "exp_form"])
    return found if "contract" in scope else found.drop("contract")


def renamed_columns(align: DataFrame) -> DataFrame:
    """For every missing column the first similar received column in source order.

    One received column may serve several missing ones.
    """
    first = F.struct("src_pos", "src_column", "src_key", "src_form", "exp_column", "exp_key", "exp_form")
    return similar_columns(align).groupBy(*_scope(align), "exp_pos").agg(
        F.min_by(first, "src_pos").alias("m")).select(
        *_scope(align), "exp_pos", "m.*"
    )


def rename_similarity(align: DataFrame) -> DataFrame:
    """All similar pairs, each once."""
    return similar_columns(align).select("dataset", "exp_column", "src_column").distinct()


def rename_confidence(align: DataFrame) -> DataFrame:
    return renamed_columns(align).select(
        "dataset", "exp_column", "src_column",
        names.rename_score(F.col("exp_form"), F.col("src_form")).alias("confidence"),
    )


def _type_check(allow_safe_promotion: bool) -> Column:
    want, got = F.col("exp_norm"), F.col("src_norm")
    if not allow_safe_promotion:
        return F.when(want != got, F.lit(fixed.TYPE_CHANGE))
    return F.when((want != got) & names.is_safe_promotion(want, got), F.lit(fixed.PROMOTION)).when(
        want != got, F.lit(fixed.TYPE_CHANGE)
    )


def type_issues(matched: DataFrame, check: str, allow_safe_promotion: bool = True) -> DataFrame:
    """Matched columns with a ``type.change`` or ``type.promotion``."""
    return matched.withColumn("check", _type_check(allow_safe_promotion)).filter(F.col("check") == check)


def _offers(assignments: DataFrame, rules: DataFrame, received: DataFrame) -> DataFrame:
    """For each contract and received name form: the contract's name forms that it may be the new name of."""
    wanted = rules.select("contract", names.name_form(F.col("column")).alias("form"))
    # both sides grow with the fleet: a shuffle by dataset, never one side sent whole to every task
    arrived = received.select("dataset", names.name_form(F.col("column")).alias("form")).join(
        assignments.select("dataset", "contract").hint("merge"), "dataset").select("contract", "form")
    pairs = similar_names(*[forms.filter(F.col("form") != "").distinct() for forms in (wanted, arrived)])
    return pairs.groupBy("contract", F.col("src_form").alias("own_form")).agg(F.collect_set("exp_form").alias("offers"))


def schema_findings(
    assignments: DataFrame, rules: DataFrame, received: DataFrame,
    allow_safe_promotion: bool = True, warn_extra_columns: bool = True,
) -> DataFrame:
    """Every schema finding: dataset, contract, phase, pos, check, severity, column, expected, actual.

    ``phase`` 0 holds findings on contract columns (by contract position), 1 undeclared columns
    (by source position).

    The alignment is worked out once.  An undeclared column offers itself, by an extra row, to each similar
    name of the contract; a missing column takes the first offer in source order, and the offers taken go
    back to their columns.  Both meetings are windows keyed by dataset, contract and name or place.
    """
    align = aligned(assignments, rules, received)
    declared, absent = F.col("exp_pos").isNotNull(), F.col("src_pos").isNull()
    form = names.name_form(F.coalesce("exp_column", "src_column"))
    # a matched column has nothing to offer; its own key, marked, keeps it from meeting others in one task
    alone = F.concat(F.lit("#"), "key")
    offering = align.withColumn("own_form", F.when(declared, alone).otherwise(form)).join(
        _offers(assignments, rules, received), ["contract", "own_form"], "left")
    itself = F.array(F.when(absent, form).otherwise(alone))
    links = offering.withColumn("offers", F.coalesce("offers", F.array().cast("array<string>"))).select(
        *[c for c in offering.columns if c not in ("own_form", "offers")], F.posexplode(F.concat(itself, "offers")).alias("at", "link"))
    is_offer = F.col("at") > 0
    same_name = Window.partitionBy("dataset", "contract", "link")
    met = links.withColumn("first", F.min(F.when(is_offer, F.struct("src_pos", "src_column"))).over(same_name)).withColumn(
        "wanted", F.max((absent & ~is_offer)).over(same_name))
    taken = is_offer & F.col("wanted") & (F.col("src_pos") == F.col("first.src_pos"))
    check = (
        F.when(absent & F.col("first").isNotNull(), F.lit(fixed.RENAMED))
        .when(absent, F.lit(fixed.MISSING))
        .when(declared, _type_check(allow_safe_promotion))
        .when(F.lit(warn_extra_columns), F.lit(fixed.EXTRA))
    )
    found = met.withColumn("check", F.when(~is_offer, check)).withColumn("taken", taken).filter(
        F.col("check").isNotNull() | F.col("taken"))
    if warn_extra_columns:
        same_place = Window.partitionBy("dataset", "contract", F.col("exp_pos").isNull(), F.coalesce("exp_pos", "src_pos"))
        found = found.withColumn("renamed", F.max("taken").over(same_place)).filter(
            F.col("check").isNotNull() & ((F.col("check") != fixed.EXTRA) | ~F.col("renamed")))
    else:
        found = found.filter(F.col("check").isNotNull())
    is_rename = F.col("check") == fixed.RENAMED
    optional = (F.col("check") == fixed.MISSING) & ~F.col("exp_required")
    warns = F.col("check").isin(fixed.PROMOTION, fixed.EXTRA) | optional
    return found.select(
        "dataset", "contract", F.when(declared, 0).otherwise(1).alias("phase"), F.coalesce("exp_pos", "src_pos").alias("pos"),
        "check", F.when(warns, F.lit(fixed.WARN)).otherwise(F.lit(fixed.FAIL)).alias("severity"),
        F.coalesce("exp_column", "src_column").alias("column"),
        F.when(is_rename, F.col("exp_column")).otherwise(F.col("exp_type")).alias("expected"),
        F.when(is_rename, F.col("first.src_column")).otherwise(F.col("src_type")).alias("actual"),
    )


def number_findings(findings: DataFrame) -> DataFrame:
    """Findings as ``issues``: ordered per dataset and contract (bounded by its columns), with texts."""
    order = Window.partitionBy("dataset", "contract").orderBy("phase", "pos")
    return catalog.describe_issues(
        findings.withColumn("ord", F.row_number().over(order).cast("long"))
        .withColumn("expected_values", F.lit(None).cast("array<string>"))
        .withColumn("row", F.lit(None).cast("long"))
    )


def missing_columns(assignments: DataFrame, rules: DataFrame, received: DataFrame) -> DataFrame:
    """Contract columns that are absent and not merely renamed."""
    return schema_findings(assignments, rules, received, warn_extra_columns=False).filter(
        F.col("check") == fixed.MISSING
    )


def extra_columns(assignments: DataFrame, rules: DataFrame, received: DataFrame) -> DataFrame:
    """Received columns that are neither declared nor the new name of a contract column."""
    return schema_findings(assignments, rules, received).filter(F.col("check") == fixed.EXTRA)


def schema_diff(
    assignments: DataFrame, rules: DataFrame, received: DataFrame,
    allow_safe_promotion: bool = True, warn_extra_columns: bool = True,
) -> DataFrame:
    return number_findings(
        schema_findings(assignments, rules, received, allow_safe_promotion, warn_extra_columns)
    )


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Classify the difference between two versions of contracts, column by column."""
    def side(rules: DataFrame, mark: str) -> DataFrame:
        return rules.select(
            "contract", names.match_key(F.col("column")).alias("key"),
            *[F.col(c).alias(f"{mark}_{c}") for c in ("column", "type", "required", "format")],
        )

    both = side(old, "old").join(side(new, "new"), ["contract", "key"], "full_outer")
    gone, added = F.col("new_column").isNull(), F.col("old_column").isNull()
    was_required = F.coalesce("old_required", F.lit(False))
    now_required = F.coalesce("new_required", F.lit(False))
    old_type, new_type = names.type_form(F.col("old_type")), names.type_form(F.col("new_type"))
    change = (
        F.when(gone & was_required, "required column removed")
        .when(gone, "optional column removed")
        .when(added & now_required, "required column added")
        .when(added, "optional column added")
        .when(old_type != new_type, "type changed")
        .when(F.coalesce("old_format", F.lit("")) != F.coalesce("new_format", F.lit("")), "format changed")
        .when(~was_required & now_required, "became required")
        .when(was_required & ~now_required, "became optional")
    )
    grade = (
        F.when(F.col("change").isin("required column removed", "required column added", "became required"), "breaking")
        .when(F.col("change").isin("type changed", "format changed"), "potentially breaking")
        .otherwise("compatible")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        "contract", F.coalesce("new_column", "old_column").alias("column"), "change", grade.alias("grade")
    )


def naming_violations(received: DataFrame) -> DataFrame:
    """Columns whose names are not snake_case."""
    return received.filter(~F.col("column").rlike(r"\A[a-z][a-z0-9]*(?:_[a-z0-9]+)*\z"))
