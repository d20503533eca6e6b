"""Gate, budgets and golden-case evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import fixed


class ContractViolation(RuntimeError):
    """Raised by ``enforce_gate`` when a dataset is blocked."""


def gate(statuses: DataFrame, fail_on_warning: bool = False) -> DataFrame:
    """Add ``decision``: block on FAIL (and on WARN if asked), else allow."""
    blocked = [fixed.FAIL, fixed.WARN] if fail_on_warning else [fixed.FAIL]
    return statuses.withColumn(
        "decision", F.when(F.col("status").isin(blocked), F.lit("block")).otherwise(F.lit("allow"))
    )


def enforce_gate(statuses: DataFrame, fail_on_warning: bool = False, name: int = 10) -> None:
    """Stop the job if any dataset is blocked under any of its contracts; the error names some of them."""
    blocked = gate(statuses, fail_on_warning).filter(F.col("decision") == "block")
    shown = [row["dataset"] for row in blocked.select("dataset").distinct().orderBy("dataset").limit(name).collect()]
    if shown:
        raise ContractViolation(f"contract violated by {', '.join(shown)}")


def cost_units(assignments: DataFrame, rules: DataFrame, received: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Units per dataset: source columns x contract columns + rows x contract columns.

    ``row_counts`` gives (dataset, data_rows); a dataset without rows counts none.
    """
    source = received.groupBy("dataset").agg(F.count(F.lit(1)).alias("source_columns"))
    contract = rules.groupBy("contract").agg(F.count(F.lit(1)).alias("contract_columns"))
    zero = F.lit(0).cast("long")
    sized = (
        assignments.select("dataset", "contract").join(contract, "contract", "left")
        .join(source, "dataset", "left").join(row_counts.select("dataset", "data_rows"), "dataset", "left")
        .select(
            "dataset", "contract", F.coalesce("source_columns", zero).alias("source_columns"),
            F.coalesce("contract_columns", zero).alias("contract_columns"),
            F.coalesce("data_rows", zero).alias("data_rows"),
        )
    )
    return sized.withColumn(
        "estimated_units",
        F.col("source_columns") * F.col("contract_columns") + F.col("data_rows") * F.col("contract_columns"),
    )


def count_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(dataset, data_rows) of tables.  A scan that asks for no column takes the rows of Parquet files from their
    footers; no data page is read."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("data_rows")).select(F.lit(name).alias("dataset"), "data_rows") for name, df in frames.items()])


def budget_check(
    costs: DataFrame, max_columns: int = fixed.MAX_COLUMNS, max_contract_columns: int = fixed.MAX_CONTRACT_COLUMNS,
    max_data_rows: int | None = fixed.MAX_DATA_ROWS,
) -> DataFrame:
    """Add ``breach``: the first limit exceeded, null within budget.

    ``max_data_rows=None`` lifts the row limit, the normal case here: whole tables are checked.
    """
    breach = F.when(F.col("source_columns") > max_columns, F.lit("source_columns")).when(
        F.col("contract_columns") > max_contract_columns, F.lit("contract_columns")
    )
    if max_data_rows is not None:
        breach = breach.when(F.col("data_rows") > max_data_rows, F.lit("data_rows"))
    return costs.withColumn("breach", breach)


def evaluate_cases(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """Compare golden cases with the reports of their datasets: name, passed, failures.

    ``cases``: name, dataset, contract, expected_status, expected_checks, expected_corrections.  Expected checks
    and corrections must occur; others may.  An expected status that is null, empty or NONE is not looked at.  A
    case meets its report once, by dataset and contract (by dataset alone where cases name no contract), and is
    judged inside the row.
    """
    by = ["dataset", "contract"] if "contract" in cases.columns else ["dataset"]
    kept = reports.select(
        "dataset", "contract", "status", F.col("issues.check").alias("checks"), F.col("corrections.action").alias("actions"))
    met = cases.join(kept.select(*by, "status", "checks", "actions"), by, "left")
    wanted = F.coalesce("expected_status", F.lit("NONE"))
    wrong = ~wanted.isin("", "NONE") & ~F.col("status").eqNullSafe(wanted)
    said = F.concat(F.lit("status expected "), wanted, F.lit(" got "), F.coalesce("status", F.lit("none")))

    def absent(expected: str, found: str, kind: str) -> Column:
        none = F.array().cast("array<string>")
        lost = F.filter(F.coalesce(expected, none), lambda x: ~F.array_contains(F.coalesce(found, none), x))
        return F.transform(lost, lambda x: F.concat(F.lit(f"missing {kind} "), x))

    failures = F.concat(
        F.array_compact(F.array(F.when(wrong, said))), absent("expected_checks", "checks", "check"),
        absent("expected_corrections", "actions", "correction"))
    return met.select("name", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def all_passed(results: DataFrame) -> DataFrame:
    """One row: did every case pass, and how many there were."""
    return results.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("case_count")
    )
