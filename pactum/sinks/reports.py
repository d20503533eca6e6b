"""Report, alert and run-history sinks.  The writers append or replace files through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import fixed


def report_json(reports: DataFrame, costs: DataFrame | None = None, trace: str | None = None) -> DataFrame:
    """One JSON document per dataset and contract with the whole result: issues, corrections, analysis,
    recommendations, fixes, texts, and trace and cost where given (``gate.cost_units``).

    Absent fields are left out, a list of accepted values stays a list.
    """
    issue = F.transform("issues", lambda x: F.struct(
        x["severity"].alias("severity"), x["check"].alias("check"), x["column"].alias("column"),
        x["message"].alias("message"),
        F.coalesce(
            F.to_variant_object(x["expected_values"]), x["expected"].cast("variant")
        ).alias("expected"),
        x["actual"].alias("actual"), x["row"].alias("row"), x["impact"].alias("impact"),
    ))
    parts = [
        F.col("contract"), F.col("dataset").alias("source"), F.col("status"),
        F.struct(
            F.col("fail_count").alias(fixed.FAIL), F.col("warn_count").alias(fixed.WARN),
            F.col("info_count").alias(fixed.INFO),
        ).alias("counts"),
        issue.alias("issues"), F.col("corrections"),
        F.struct("label", "summary", "problems", "causes", "impacts", "plan").alias("analysis"),
        F.col("plan").alias("recommendations"), F.col("fixes"),
        F.struct(
            "explanation", F.col("business_impact").alias("businessImpact"), F.col("proposed_correction").alias("proposedCorrection"),
            F.col("supplier_message").alias("supplierMessage")).alias("texts"),
    ]
    if trace is not None:
        parts.append(F.lit(trace).alias("trace"))
    if costs is not None:
        sizes = [c for c in ("source_columns", "contract_columns", "data_rows", "estimated_units", "breach") if c in costs.columns]
        reports = reports.join(costs.select("dataset", "contract", F.struct(*sizes).alias("cost")), ["dataset", "contract"], "left")
        parts.append(F.col("cost"))
    return reports.select("dataset", "contract", F.to_json(F.struct(*parts)).alias("json"))


def _cell(value: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")


def _table(head: list[str], rows: Column) -> Column:
    """``rows``: an array of arrays of texts."""
    lines = F.transform(rows, lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")))
    start = f"| {' | '.join(head)} |\n|{' -- |' * len(head)}\n"
    return F.concat(F.lit(start), F.array_join(lines, "\n"))


def _section(title: str, there: Column, body: Column) -> Column:
    return F.when(there, F.concat(F.lit(f"\n\n## {title}\n\n"), body)).otherwise(F.lit(""))


def _list(title: str, name: str) -> Column:
    body = F.array_join(F.transform(name, lambda x: F.concat(F.lit("* "), x)), "\n")
    return _section(title, F.size(name) > 0, body)


def report_markdown(reports: DataFrame) -> DataFrame:
    """One Markdown document per dataset and contract; empty sections are left out."""
    issues = F.transform("issues", lambda x, i: F.array(
        (i + 1).cast("string"), x["severity"], x["check"], _cell(x["column"]), _cell(x["message"]),
        _cell(F.coalesce(F.array_join(x["expected_values"], ", "), x["expected"])), _cell(x["actual"]),
        F.coalesce(x["row"].cast("string"), F.lit("")), _cell(x["impact"])))
    corrections = F.transform("corrections", lambda x: F.array(x["action"], _cell(x["target"]), _cell(x["suggestion"])))
    text = F.concat(
        F.lit("# `"), F.col("dataset"), F.lit("`: "), F.col("label"),
        F.lit("\n\nChecked against `"), F.col("contract"), F.lit("`. Status "), F.col("status"), F.lit(" ("), F.col("summary"), F.lit(")."),
        _list("In short", "problems"), _list("Likely origin", "causes"), _list("Consequences", "impacts"), _list("Next steps", "plan"),
        _section("Corrections", F.size("corrections") > 0, _table(["action", "target", "how"], corrections)),
        _list("Runnable", "fixes"),
        _section("Findings", F.size("issues") > 0, _table(
            ["no.", "severity", "check", "column", "what", "agreed", "found", "row", "effect"], issues)),
    )
    return reports.select("dataset", "contract", text.alias("markdown"))


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rendered reports as JSON lines (dataset and its document)."""
    documents.write.mode(mode).json(path)


def alerts(reports: DataFrame, channel: str, severity: str = fixed.FAIL) -> DataFrame:
    """Alert rows for failing reports (and warning ones with ``severity=WARN``), one a dataset and contract."""
    wanted = [fixed.FAIL] if severity == fixed.FAIL else [fixed.FAIL, fixed.WARN]
    return reports.filter(F.col("status").isin(wanted)).select(
        F.lit(channel).alias("channel"),
        F.concat(F.col("status"), F.lit(" "), F.col("dataset"), F.lit(" / "), F.col("contract")).alias("title"),
        F.col("supplier_message").alias("text"),
    )


def append_alerts(alert_rows: DataFrame, path: str) -> None:
    alert_rows.write.mode("append").json(path)


def run_history(reports: DataFrame, units: DataFrame, trace: str) -> DataFrame:
    """One history row per report.  ``units`` gives dataset, contract and estimated_units."""
    by = ["dataset", "contract"]
    return reports.join(units.select(*by, "estimated_units"), by, "left").select(
        F.current_timestamp().alias("ts"), F.lit(trace).alias("trace_id"), "status",
        F.col("dataset").alias("source"), "contract", (F.col("fail_count") + F.col("warn_count") + F.col("info_count")).alias("issue_count"),
        "estimated_units",
    )


def append_runs(runs: DataFrame, path: str):
    """Append history rows; returns the observation with the run's totals, measured while writing."""
    from pyspark.sql import Observation

    seen = Observation("runs")
    runs.observe(
        seen, F.count(F.lit(1)).alias("reports"),
        F.count_if(F.col("status") == fixed.FAIL).alias("failed"),
        F.sum("issue_count").alias("issues"),
    ).write.mode("append").parquet(path)
    return seen
