"""Whole validations: one dataset, or a fleet of them, from inputs to report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import gate, remediate, report, row_issues, schema_diff
from pactum.sources import schemas
from pactum.types import ASSIGNMENTS, Contract, rules_frame


def merged_issues(
    assignments: DataFrame, rules: DataFrame, received: DataFrame, cell_totals: DataFrame | None = None,
    allow_safe_promotion: bool = True, warn_extra_columns: bool = True,
) -> DataFrame:
    """Schema findings and row findings of every dataset under each of its contracts; ``ord`` is their order and
    ``n`` the number of cells of each."""
    found = schema_diff.schema_findings(assignments, rules, received, allow_safe_promotion, warn_extra_columns)
    return report.placed(found, cell_totals)


def statuses(
    assignments: DataFrame, rules: DataFrame, received: DataFrame, bad_cells: DataFrame | None = None,
    allow_safe_promotion: bool = True, warn_extra_columns: bool = True,
) -> DataFrame:
    """Status and counts alone, from ``row_issues.bad_cell_counts``: no lists, no texts, no example values."""
    found = schema_diff.schema_findings(assignments, rules, received, allow_safe_promotion, warn_extra_columns).select("dataset", "contract", "severity")
    if bad_cells is not None:
        found = found.unionByName(bad_cells.select("dataset", "contract", "severity", "n"), allowMissingColumns=True)
    return report.status_counts(assignments, found)


def all_totals(df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None) -> DataFrame:
    """Row findings of a table; repeated values too, where a contract asks for unique ones."""
    totals = row_issues.cell_totals(df, contracts, row, dataset, contract_col)
    if any(rule.unique for contract in contracts for rule in contract.rules):
        totals = totals.unionByName(row_issues.unique_totals(df, contracts, row, dataset, contract_col))
    return totals


def _issues(
    spark: SparkSession, name: str, df: DataFrame, contract: Contract, row: Column | None,
    received: DataFrame | None, cap: int | None, **options: bool,
) -> tuple[DataFrame, DataFrame]:
    assignments = spark.createDataFrame([(name, contract.name)], ASSIGNMENTS)
    received = schemas.schema_of(spark, {name: df}) if received is None else received
    found = None
    if row is not None and cap is None:
        found = all_totals(df, [contract], row, F.lit(name))
    elif row is not None:
        # one cell each, in the order of the sample
        found = row_issues.issue_sample(df, [contract], row, F.lit(name), cap=cap).withColumn("pos", F.col("n")).withColumn("n", F.lit(1))
    return assignments, merged_issues(assignments, rules_frame(spark, contract), received, found, **options)


def dataset_issues(
    spark: SparkSession, name: str, df: DataFrame, contract: Contract, row: Column | None = None,
    received: DataFrame | None = None, cap: int | None = None, **options: bool,
) -> DataFrame:
    """Issues of one dataset.

    ``row`` numbers the rows; without it only the schema is compared.  ``received`` is the
    dataset's schema when it is not simply that of ``df`` (a CSV's inferred types).  The row
    issues are one per column and check with exact counts; with a ``cap`` they are the first ``cap``.
    """
    _, issues = _issues(spark, name, df, contract, row, received, cap, **options)
    return report.numbered_issues(report.issue_lists(issues))


def validate_dataset(
    spark: SparkSession, name: str, df: DataFrame, contract: Contract, row: Column | None = None,
    received: DataFrame | None = None, cap: int | None = None, **options: bool,
) -> DataFrame:
    """Report row of one dataset; arguments as in ``dataset_issues``."""
    return report.validation_report(*_issues(spark, name, df, contract, row, received, cap, **options))


def remediate_dataset(
    spark: SparkSession, name: str, df: DataFrame, contract: Contract, row: Column,
    received: DataFrame | None = None, also_formats: dict[str, list[str]] | None = None, **options: bool,
) -> tuple[DataFrame, DataFrame]:
    """Validate a whole table exactly and carry out the fixes: (valid rows, rejected rows)."""
    _, issues = _issues(spark, name, df, contract, row, received, None, **options)
    return remediate.apply_plan(df, contract, report.remediation_plan(issues), also_formats)


def within_budget(
    spark: SparkSession, members: list[tuple[str, DataFrame, Contract, Column]], **limits: int | None,
) -> tuple[list[tuple[str, DataFrame, Contract, Column]], DataFrame]:
    """The members of a fleet that keep to the limits of ``gate.budget_check``, and the costs of all with the limit
    that each breaks; known from schemas and footers, before any table is scanned."""
    assignments = spark.createDataFrame([(name, c.name) for name, _, c, _ in members], ASSIGNMENTS)
    frames = {name: df for name, df, _, _ in members}
    contracts = {c.name: c for _, _, c, _ in members}
    costs = gate.budget_check(gate.cost_units(
        assignments, rules_frame(spark, *contracts.values()), schemas.schema_of(spark, frames), gate.count_rows(frames)), **limits)
    broken = {(r["dataset"], r["contract"]) for r in costs.filter(F.col("breach").isNotNull()).collect()}  # a row a member at most
    return [m for m in members if (m[0], m[2].name) not in broken], costs


def validate_fleet(
    spark: SparkSession, members: list[tuple[str, DataFrame, Contract, Column]], **options: bool,
) -> DataFrame:
    """Report rows of many tables, each with its own contract, in one plan.

    Every table is counted by column and check on its own; only these counts meet in the union.
    """
    assignments = spark.createDataFrame([(name, c.name) for name, _, c, _ in members], ASSIGNMENTS)
    received = schemas.schema_of(spark, {name: df for name, df, _, _ in members})
    contracts = {c.name: c for _, _, c, _ in members}
    totals = reduce(DataFrame.unionByName, [
        all_totals(df, [contract], row, F.lit(name)) for name, df, contract, row in members
    ])
    # a table that is checked under several contracts has one schema
    issues = merged_issues(assignments, rules_frame(spark, *contracts.values()), received, totals, **options)
    return report.validation_report(assignments, issues)


def fleet_counts(members: list[tuple[str, DataFrame, Contract, Column]]) -> DataFrame:
    """Exact violation counts of many tables, one scan each, one shuffle of counts."""
    return reduce(DataFrame.unionByName, [
        row_issues.violation_counts(df, [contract], F.lit(name)) for name, df, contract, _ in members
    ])
