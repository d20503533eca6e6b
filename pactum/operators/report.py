"""From issues to reports.

A dataset is judged under each of its contracts by itself: everything here is keyed by (dataset, contract).

The issues of a dataset under a contract are few (schema findings, bounded by its columns, and one row finding a
column and check), so one aggregation brings them together as a sorted array (``issue_lists``), and all lists of a
report are worked out inside that row by array expressions: no join, no second shuffle, no sort of single issues.
Status and counts alone need no lists at all (``severity_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import fixed
from pactum.operators import catalog

ISSUE_FIELDS = ["severity", "check", "column", "message", "expected", "expected_values", "actual", "row", "impact"]
_GIVEN = ["severity", "check", "column", "expected", "expected_values", "actual", "row"]
_BY = ["dataset", "contract"]


# -- bringing issues together ------------------------------------------------------------------


def placed(schema_findings: DataFrame, cell_totals: DataFrame | None = None) -> DataFrame:
    """Schema findings and row findings of many datasets in one table, with their order in ``ord``: contract
    columns, undeclared columns, then rows by contract column, the empty cells of a column last."""
    late = (F.col("check") == fixed.REQUIRED).cast("int")

    def fields(phase: Column, last: Column) -> list[Column | str]:
        place = F.struct(
            phase.alias("phase"), F.col("pos").cast("int").alias("pos"), last.alias("late"), F.col("row").cast("long").alias("row"),
            F.col("check").alias("name"))
        return [*_BY, place.alias("ord"), *_GIVEN, F.coalesce("n", F.lit(1)).cast("long").alias("n")]

    missing = {"row": "long", "n": "long", "expected_values": "array<string>"}
    schema = schema_findings.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}).select(*fields(F.col("phase"), F.lit(0)))
    if cell_totals is None:
        return schema
    return schema.unionByName(cell_totals.select(*fields(F.lit(2), late)))


def issue_lists(issues: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """One row per dataset and contract with its ``issues``, in order and numbered from 1.

    ``issues`` has the order of a dataset's issues in ``ord``, of whatever type, and may have the number of cells
    that an issue stands for in ``n``.  With ``assignments`` all of these have a row, and no others; they come
    along in the same aggregation.
    """
    n = F.coalesce("n", F.lit(1)) if "n" in issues.columns else F.lit(1)
    rows = issues.select(*_BY, F.struct("ord", *_GIVEN, n.cast("long").alias("n")).alias("found"))
    if assignments is not None:
        asked = assignments.select(*_BY, F.lit(None).cast(rows.schema["found"].dataType).alias("found"), F.lit(True).alias("asked"))
        rows = rows.withColumn("asked", F.lit(False)).unionByName(asked)
    lists = rows.groupBy(*_BY).agg(
        F.sort_array(F.collect_list("found")).alias("found"), *([F.max("asked").alias("asked")] if assignments is not None else []))
    if assignments is not None:
        lists = lists.filter("asked")
    fields = ", ".join(f"'{c}', x.`{c}`" for c in ("severity", "check", "column"))
    rest = ", ".join(f"'{c}', x.`{c}`" for c in ("expected", "expected_values", "actual", "row"))
    numbered = (
        f"transform(found, (x, i) -> named_struct('ord', CAST(i + 1 AS BIGINT), {fields}, "
        f"'message', {catalog.by_check_sql(catalog.MESSAGES, 'x')}, {rest}, "
        f"'impact', {catalog.by_check_sql(catalog.ISSUE_IMPACTS, 'x')}, 'n', x.n))"
    )
    return lists.select(*_BY, F.expr(numbered).alias("issues"))


def numbered_issues(lists: DataFrame) -> DataFrame:
    """The issues of ``issue_lists``, a row each."""
    return lists.select(*_BY, F.inline("issues")).select(*_BY, "ord", *ISSUE_FIELDS, "n")


def _lists(issues: DataFrame) -> DataFrame:
    return issues if "issues" in issues.columns else issue_lists(issues)


# -- status ------------------------------------------------------------------------------------


def status_of(rank: Column) -> Column:
    return F.when(rank >= 2, F.lit(fixed.FAIL)).when(rank == 1, F.lit(fixed.WARN)).otherwise(F.lit(fixed.PASS))


def severity_counts(issues: DataFrame) -> DataFrame:
    """Cells by severity: an issue that sums up many cells counts as many.

    Reads dataset, contract, severity (and ``n``): sums of numbers, combined on the map side.
    """
    n = F.coalesce("n", F.lit(1)) if "n" in issues.columns else F.lit(1)
    return issues.groupBy(*_BY).agg(
        *[F.sum(F.when(F.col("severity") == s, n).otherwise(0)).cast("long").alias(s) for s in (fixed.FAIL, fixed.WARN, fixed.INFO)])


def _status(fails: Column, warns: Column) -> Column:
    return status_of(F.when(fails > 0, 2).when(warns > 0, 1).otherwise(0))


def status_counts(assignments: DataFrame, issues: DataFrame) -> DataFrame:
    """Status, fail_count and warn_count of every dataset under each of its contracts; one without issues passes.

    Assignments come along in the same aggregation, as rows without a severity.
    """
    n = F.coalesce("n", F.lit(1)) if "n" in issues.columns else F.lit(1)
    rows = issues.select(*_BY, "severity", n.cast("long").alias("n"), F.lit(False).alias("asked")).unionByName(
        assignments.select(*_BY, F.lit(None).cast("string").alias("severity"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    counts = rows.groupBy(*_BY).agg(
        *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).cast("long").alias(name)
          for s, name in ((fixed.FAIL, "fail_count"), (fixed.WARN, "warn_count"))],
        F.max("asked").alias("asked"))
    return counts.filter("asked").select(*_BY, _status(F.col("fail_count"), F.col("warn_count")).alias("status"), "fail_count", "warn_count")


def status_rollup(assignments: DataFrame, issues: DataFrame) -> DataFrame:
    """Worst severity per dataset and contract; a dataset without issues passes."""
    return status_counts(assignments, issues).select(*_BY, "status")


# -- lists inside a row ------------------------------------------------------------------------


def _first(array: str, key: str) -> str:
    """Elements whose key has not been seen before in the array; ``key`` is SQL over the element ``y``."""
    return f"filter({array}, (y, j) -> array_position(transform({array}, y -> {key}), {key}) = j + 1)"


def _texts_sql(templates: dict[str, str]) -> str:
    lines = f"transform(issues, x -> named_struct('ord', x.ord, 'text', {catalog.by_check_sql(templates, 'x')}))"
    return f"filter({lines}, y -> y.text IS NOT NULL)"


_GROUP_KEY = (
    "concat_ws('\u0001', y.`check`, y.`column`, coalesce(y.expected, '\u0002'), "
    "coalesce(array_join(y.expected_values, '\u0003'), '\u0002'))"
)
# columns that a report row gets on the way to its lists, each step over those before it
_STEPS: list[dict[str, str]] = [
    {
        "correction_list": "filter(transform(issues, x -> named_struct('ord', x.ord, "
                           f"'action', {catalog.by_check_sql(fixed.ACTIONS, 'x')}, "
                           f"'target', {catalog.by_check_sql(catalog.TARGETS, 'x', catalog.OTHER_TARGET)}, "
                           f"'suggestion', {catalog.by_check_sql(catalog.SUGGESTIONS, 'x')})), y -> y.action IS NOT NULL)",
        "cause_list": _texts_sql(catalog.CAUSES),
        "plan_list": _texts_sql(catalog.PLAN),
        "fix_list": "filter(transform(issues, x -> named_struct('ord', x.ord, "
                    f"'operation', {catalog.by_check_sql(catalog.FIX_OPERATIONS, 'x')}, "
                    f"'title', {catalog.by_check_sql(catalog.FIX_TITLES, 'x')}, 'column', x.`column`, 'expected', x.expected, "
                    "'actual', x.actual, 'check', x.`check`)), y -> y.operation IS NOT NULL)",
        "group_list": f"transform(issues, y -> named_struct('key', {_GROUP_KEY}, 'n', y.n))",
        "group_keys": f"transform(issues, y -> {_GROUP_KEY})",
    },
    {
        "correction_list": _first("correction_list", "concat_ws('\u0001', y.action, y.target)"),
        "cause_list": _first("cause_list", "y.text"),
        "plan_list": _first("plan_list", "y.text"),
        "fix_list": _first("fix_list", "y.title"),
        # the first issue of a group, and the group's cells; empty cells say their number themselves
        "problem_list": "transform(filter(issues, (y, j) -> array_position(group_keys, group_keys[j]) = j + 1), "
                        "x -> named_struct('ord', x.ord, 'check', x.`check`, 'column', x.`column`, 'expected', x.expected, "
                        "'expected_values', x.expected_values, 'actual', x.actual, 'message', x.message, 'n', "
                        "aggregate(group_list, 0L, (sum, g) -> sum + if(g.key = group_keys[CAST(x.ord - 1 AS INT)], g.n, 0L))))",
    },
    {
        "problem_list": "transform(problem_list, x -> named_struct('ord', x.ord, 'check', x.`check`, 'column', x.`column`, "
                        "'expected', x.expected, 'expected_values', x.expected_values, 'actual', x.actual, 'message', x.message, 'n', x.n, "
                        f"'cells', if(x.`check` = '{fixed.REQUIRED}' AND x.actual RLIKE '^[0-9]+ ', split(x.actual, ' ')[0], CAST(x.n AS STRING))))",
    },
    {
        "problem_list": "transform(problem_list, x -> named_struct('ord', x.ord, 'check', x.`check`, 'column', x.`column`, 'n', x.n, "
                        f"'text', {catalog.by_check_sql(catalog.PROBLEMS, 'x', catalog.OTHER_PROBLEM)}))",
    },
]


def _with_lists(lists: DataFrame, *wanted: str) -> DataFrame:
    """Add the named lists (all without names), step by step."""
    for step in _STEPS:
        needed = {
            name: F.expr(sql) for name, sql in step.items()
            if not wanted or name in wanted or (name in ("group_list", "group_keys") and "problem_list" in wanted)
        }
        if needed:
            lists = lists.withColumns(needed)
    return lists.drop("group_list", "group_keys")


def _lines(issues: DataFrame, name: str) -> DataFrame:
    return _with_lists(_lists(issues), name).select(*_BY, F.inline(name))


def issue_corrections(issues: DataFrame) -> DataFrame:
    """One correction per issue that has one, duplicates included."""
    flat = numbered_issues(issues) if "issues" in issues.columns else issues
    return flat.withColumn("action", catalog.correction_action()).filter(F.col("action").isNotNull()).select(
        *_BY, "ord", "action", catalog.correction_target().alias("target"), catalog.correction_text().alias("suggestion"),
    )


def dedupe_corrections(issues: DataFrame) -> DataFrame:
    """First correction per dataset, contract, action and target.  Reads issues, or the corrections of issues."""
    if "action" not in issues.columns:
        return _lines(issues, "correction_list")
    entry = F.struct("ord", "action", "target", "suggestion")
    lists = issues.groupBy(*_BY).agg(F.sort_array(F.collect_list(entry)).alias("correction_list"))
    return lists.select(*_BY, F.inline(F.expr(_STEPS[1]["correction_list"])))


def problems(issues: DataFrame) -> DataFrame:
    return _lines(issues, "problem_list")


def probable_causes(issues: DataFrame) -> DataFrame:
    return _lines(issues, "cause_list")


def correction_plan(issues: DataFrame) -> DataFrame:
    return _lines(issues, "plan_list")


def remediation_plan(issues: DataFrame) -> DataFrame:
    """Fixes to carry out, each once, in order of the first issue that asks for it."""
    return _lines(issues, "fix_list")


def _impact_texts() -> Column:
    """Impacts of a row's ``issues``; they depend on which checks and columns occur at all."""
    def told(checks: list[str], columns: list[str], text: str) -> Column:
        found = F.exists("issues", lambda x: x["check"].isin(checks) if checks else F.lower(x["column"]).isin(columns))
        return F.when(found, F.lit(text))

    return F.array_distinct(F.array_compact(F.array(*[told(*rule) for rule in catalog.IMPACT_RULES])))


def impacts(issues: DataFrame) -> DataFrame:
    return _lists(issues).select(*_BY, F.posexplode(_impact_texts()).alias("pos", "text"))


# -- whole report ------------------------------------------------------------------------------


def _cells(severity: str) -> Column:
    return F.expr(f"aggregate(issues, 0L, (sum, x) -> sum + if(x.severity = '{severity}', x.n, 0L))")


def validation_report(assignments: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per dataset and contract with its whole report."""
    lists = _with_lists(issue_lists(issues, assignments)).withColumns({
        "fail_count": _cells(fixed.FAIL), "warn_count": _cells(fixed.WARN), "info_count": _cells(fixed.INFO)})
    report = lists.select(
        *_BY, _status(F.col("fail_count"), F.col("warn_count")).alias("status"), "fail_count", "warn_count", "info_count",
        F.transform("issues", lambda x: F.struct(*[x[f].alias(f) for f in ISSUE_FIELDS])).alias("issues"),
        F.transform("correction_list", lambda x: F.struct(*[x[f].alias(f) for f in ("action", "target", "suggestion")])).alias("corrections"),
        F.col("problem_list.text").alias("problems"), F.col("cause_list.text").alias("causes"), _impact_texts().alias("impacts"),
        F.col("plan_list.text").alias("plan"), F.col("fix_list.title").alias("fixes"),
    )
    return _with_texts(report)


def summary_text() -> Column:
    """Reads status, fail_count, warn_count."""
    return F.when(F.col("status") == fixed.PASS, F.lit("as agreed")).otherwise(F.concat(
        F.lit("blocking: "), F.col("fail_count").cast("string"), F.lit(", to note: "), F.col("warn_count").cast("string")))


STATUS_LABELS = {fixed.PASS: "accepted", fixed.WARN: "accepted with remarks", fixed.FAIL: "refused"}


def status_label() -> Column:
    pairs = [F.lit(part) for item in STATUS_LABELS.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), F.col("status"))


def report_summary(assignments: DataFrame, issues: DataFrame) -> DataFrame:
    return status_counts(assignments, issues).withColumn("label", status_label()).withColumn("summary", summary_text())


def _joined(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.array_join(items, "; "), F.lit("."))).otherwise(F.lit(none))


def _listed(items: Column, none: str) -> Column:
    lines = F.transform(F.slice(items, 1, fixed.TOP_K), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit(f"1) {none}"))


def _with_texts(report: DataFrame) -> DataFrame:
    """Explanation, business impact, proposed correction and message to the supplier.

    The texts follow from the status; nothing here can change it.  Where no check of the report has a line in
    the plan, the suggestions of its corrections stand in for it.
    """
    passed = F.col("status") == fixed.PASS
    subject = F.concat(F.lit("`"), F.col("dataset"), F.lit("` under `"), F.col("contract"), F.lit("`"))
    report = report.withColumn("advice", F.when(F.size("plan") > 0, F.col("plan")).otherwise(F.col("corrections")["suggestion"]))
    explanation = F.when(passed, F.concat(subject, F.lit(": all as agreed."))).otherwise(_joined(F.col("problems"), "The delivery departs from its contract."))
    impact = F.when(passed, F.lit("None by the rules of the contract.")).otherwise(_joined(F.col("impacts"), "Not known for these checks."))
    correction = F.when(passed, F.lit("None.")).otherwise(_joined(F.col("advice"), "Mend the delivery, or agree on a new version of the contract."))
    message = F.when(passed, F.concat(F.lit("Delivery accepted: "), subject, F.lit("."))).otherwise(F.concat(
        F.lit("Delivery "), status_label(), F.lit(": "), subject, F.lit("\n\nWhat we found\n"), _listed(F.col("problems"), "departures from the contract"),
        F.lit("\n\nWhat we ask for\n"), _listed(F.col("advice"), "a delivery, or a contract, that fits"),
        F.lit("\n\nIf this is how it is meant to be, tell us and we will change the contract together."),
    ))
    return (
        report.withColumn("label", status_label()).withColumn("summary", summary_text())
        .withColumn("explanation", explanation).withColumn("business_impact", impact)
        .withColumn("proposed_correction", correction).withColumn("supplier_message", message).drop("advice")
    )


def query_text() -> Column:
    """Search text for policy passages: all problem and plan lines of a report."""
    lines = F.array_join(F.concat(F.col("problems"), F.col("plan")), "\n")
    return F.when(lines == "", F.lit(fixed.DEFAULT_QUERY_TEXT)).otherwise(lines)
