"""Reports, corrections, gate, budgets and golden cases over the fleet of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import gate, report, row_issues
from pactum.plans import validate
from pactum.session import work_folder
from pactum.sinks import reports as sinks
from workload import inputs, oracle
from workload.oracle import quote

QUERIES: dict = {}
ORACLES: dict = {}


def _fleet(spark: SparkSession, sf_dir: str):
    return inputs.feeds(spark, sf_dir), inputs.rules(spark), inputs.feed_columns(spark, sf_dir)


def fleet_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = row_issues.cell_totals(
        inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("row"), F.col("dataset"), "contract")
    return validate.merged_issues(*_fleet(spark, sf_dir), totals)


def fleet_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = row_issues.bad_cell_counts(inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("dataset"), "contract")
    return validate.statuses(*_fleet(spark, sf_dir), bad)


def fleet_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.validation_report(inputs.feeds(spark, sf_dir), fleet_issues(spark, sf_dir))


# -- what the checking engine says, in words of its own file ----------------------------------------------


def _said(template: str, names: dict[str, str]) -> str:
    """``<name>`` stands for an SQL expression, a null of which is nothing."""
    parts, rest = [], template
    while rest:
        text, _, rest = rest.partition("<")
        if text:
            parts.append(quote(text))
        if rest:
            name, _, rest = rest.partition(">")
            parts.append(f"coalesce({names[name]}, '')")
    return f"concat({', '.join(parts)})"


_NAMES = {
    "col": '"column"', "want": "expected", "got": "actual", "bound": "regexp_replace(expected, '^.= ', '')", "list": "domain",
    "first word": "split_part(actual, ' ', 1)", "message": "message",
    "n": "CASE WHEN \"check\" = 'value.required' THEN split_part(actual, ' ', 1) ELSE CAST(n AS varchar) END",
}
_CHECKS = {
    "renamed": "column.renamed", "missing": "column.missing", "wider": "type.promotion", "type": "type.change", "extra": "column.extra",
    "empty": "value.required", "list": "value.allowed", "pattern": "value.pattern", "format": "value.format", "unreadable": "value.type",
    "low": "value.min", "high": "value.max",
}


def _by_check(texts: str, other: str = "NULL") -> str:
    """One line a check: its short name, a colon, its text."""
    lines = [line.strip().split(": ", 1) for line in texts.strip().splitlines()]
    return 'CASE "check" ' + " ".join(f"WHEN '{_CHECKS[c]}' THEN {_said(t, _NAMES)}" for c, t in lines) + f" ELSE {other} END"


SQL_ACTION = _by_check("""
    renamed: RENAME_SOURCE_COLUMN
    missing: ADD_SOURCE_COLUMN
    wider: UPDATE_CONTRACT_TYPE
    type: CAST_SOURCE_COLUMN
    extra: ADD_CONTRACT_COLUMN
    empty: FILL_REQUIRED_VALUE
    list: MAP_ALLOWED_VALUE
    pattern: FIX_VALUE_PATTERN
    format: NORMALIZE_DATE_FORMAT
    unreadable: CAST_OR_CLEAN_VALUE
    low: ENFORCE_MIN_VALUE
    high: ENFORCE_MAX_VALUE""")
SQL_TARGET = "CASE WHEN \"check\" = 'column.renamed' THEN actual ELSE \"column\" END"
SQL_MESSAGE = _by_check("""
    renamed: not delivered under its name; another column resembles it
    missing: not delivered
    wider: delivered in a wider type that holds all agreed values
    type: delivered in another type
    extra: delivered without being agreed
    empty: <first word> cells empty that must be filled
    list: value outside the agreed list
    pattern: value outside the agreed pattern
    format: date or time in another notation
    unreadable: value unreadable in the agreed type
    low: number under the agreed range
    high: number over the agreed range""")
SQL_EFFECT = _by_check("""
    renamed: queries by the agreed name find nothing
    missing: whatever reads the column comes to a halt or runs without it
    wider: none today; agreement and data should be brought in line
    type: implicit conversion on write, or a refused write
    extra: an undocumented field that someone will come to rely on
    empty: keys without a match and totals that are too low
    list: groups that no rule or filter knows
    pattern: lookups by this value miss
    format: dates read as null, or as another day
    unreadable: the cell is lost when it is converted
    low: sums and averages pulled down
    high: sums and averages pulled up""")
SQL_SUGGESTION = _by_check("""
    renamed: give `<got>` its agreed name `<want>` again
    missing: send `<col>` (<want>), or agree that it may be left out
    wider: agree on <got> for `<col>` in place of <want>
    type: turn `<col>` from <got> into <want> before it is sent
    extra: agree on `<col>` (<got>), or stop sending it
    empty: fill `<col>`, or hold back the rows without it
    list: bring `<col>` to one of: <list>
    pattern: bring `<col>` into the form <want>
    format: write `<col>` as <want>
    unreadable: send only <want> in `<col>`
    low: hold back rows with `<col>` under <bound>, or mend their source
    high: hold back rows with `<col>` over <bound>, or mend their source""")
SQL_PROBLEM = _by_check("""
    renamed: `<col>` is not there, `<got>` may be its new name
    missing: `<col>` is not there
    extra: `<col>` was never agreed
    type: `<col>` comes as <got>, agreed is <want>
    empty: `<col>`: <n> cells empty
    format: `<col>`: <n> cells not in the notation <want> (first: <got>)
    unreadable: `<col>`: <n> cells that are no <want> (first: <got>)
    pattern: `<col>`: <n> cells outside the pattern
    low: `<col>`: <n> cells under <bound>
    high: `<col>`: <n> cells over <bound>""", other=_said("`<col>`: <message>", _NAMES))
SQL_CAUSE = _by_check("""
    renamed: schema: `<want>` goes by `<got>` at its source
    format: notation: the source of `<col>` follows another convention
    low: range: low values of `<col>` pass the source unchecked
    empty: completeness: rows leave the source before `<col>` is known
    type: schema: source and agreement differ in the type of `<col>`""")
SQL_PLAN = _by_check("""
    renamed: map `<got>` to `<want>`
    missing: obtain `<col>`, or make it optional
    type: convert `<col>` to <want>
    empty: set rows without `<col>` aside
    format: rewrite `<col>` as <want>
    unreadable: cleanse `<col>` down to <want>
    low: set rows with `<col>` under <bound> aside
    high: set rows with `<col>` over <bound> aside
    extra: decide on `<col>`: agree or drop""")
SQL_FIX = _by_check("""
    renamed: <got> -> <want>
    type: <col> as <want>
    empty: <col> filled
    format: <col> in one notation
    unreadable: <col> readable
    low: <col> within range
    extra: without <col>""")
#: What makes each impact line appear, in order, and the line.
SQL_IMPACTS = [
    ("\"check\" = 'column.renamed'", "readers of an agreed name come away empty"),
    ("\"check\" = 'column.missing'", "steps that need an absent column cannot run"),
    ("\"check\" = 'type.change'", "writes convert silently or are refused"),
    ("\"check\" = 'value.format'", "days and months may trade places"),
    ("\"check\" = 'value.type'", "cells get lost in conversion"),
    ("\"check\" IN ('value.min', 'value.max')", "figures are off by values out of range"),
    ("\"check\" = 'value.required'", "joins and totals miss the rows with empty cells"),
    ("\"check\" IN ('column.missing', 'column.renamed', 'type.change', 'value.type', 'value.format')", "the load itself may break off"),
    ("lower(\"column\") = 'customer_id'", "rows may end up with the wrong customer"),
    ("lower(\"column\") = 'amount'", "money totals are not to be relied on"),
    ("lower(\"column\") IN ('email', 'mail')", "address protection may look at the wrong field"),
]

PER = "dataset, contract"
oracle.PARTS["all_corrections"] = (
    f"SELECT {PER}, ord, {SQL_ACTION} AS action, {SQL_TARGET} AS target, {SQL_SUGGESTION} AS suggestion FROM merged")
oracle.PARTS["first_corrections"] = (
    f"SELECT * FROM all_corrections QUALIFY row_number() OVER (PARTITION BY {PER}, action, target ORDER BY ord) = 1")
oracle.PARTS["problem_lines"] = f"""
    SELECT {PER}, ord, "check", "column", n, {SQL_PROBLEM} AS text FROM (
      SELECT *, CAST(sum(weight) OVER w AS bigint) AS n, row_number() OVER (w ORDER BY ord) AS place, {SQL_MESSAGE} AS message FROM merged
      WINDOW w AS (PARTITION BY {PER}, "check", "column", expected, domain))
    WHERE place = 1"""
for _name, _text in [("cause_lines", SQL_CAUSE), ("plan_lines", SQL_PLAN), ("fix_lines", SQL_FIX)]:
    oracle.PARTS[_name] = (
        f"SELECT * FROM (SELECT *, {_text} AS text FROM merged) WHERE text IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {PER}, text ORDER BY ord) = 1")
    oracle.NEEDS[_name] = ["merged"]
oracle.PARTS["impact_lines"] = (
    f"SELECT {PER}, text, row_number() OVER (PARTITION BY {PER} ORDER BY n) - 1 AS pos FROM (" + " UNION ALL ".join(
        f"SELECT {PER}, {n} AS n, {quote(text)} AS text FROM merged WHERE {where} GROUP BY {PER}"
        for n, (where, text) in enumerate(SQL_IMPACTS)) + ")")
oracle.NEEDS |= {
    "all_corrections": ["merged"], "first_corrections": ["all_corrections"], "problem_lines": ["merged"], "impact_lines": ["merged"],
}


def _register(name: str, run, sql: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = sql


_register(
    "merged_report",
    lambda spark, sf: report.numbered_issues(report.issue_lists(fleet_issues(spark, sf))).select(
        "dataset", "contract", "ord", "severity", "check", "column", "expected",
        F.array_join("expected_values", ", ").alias("domain"), "actual", "row", F.col("n").alias("weight"), "message", "impact"),
    oracle.query(f"SELECT *, {SQL_MESSAGE} AS message, {SQL_EFFECT} AS impact FROM merged", "merged"))

_register(
    "status_rollup", lambda spark, sf: fleet_statuses(spark, sf).select("dataset", "contract", "status"),
    oracle.query("SELECT dataset, contract, status FROM states", "states"))

_register(
    "severity_counts",
    lambda spark, sf: report.severity_counts(fleet_issues(spark, sf)).select(
        "dataset", "contract", F.col("FAIL").alias("fails"), F.col("WARN").alias("warns"), F.col("INFO").alias("infos")),
    oracle.query(
        f"SELECT {PER}, " + ", ".join(
            f"CAST(coalesce(sum(weight) FILTER (severity = '{s}'), 0) AS bigint) AS {s.lower()}s"
            for s in ("FAIL", "WARN", "INFO")) + f" FROM merged GROUP BY {PER}", "merged"))

_register(
    "corrections", lambda spark, sf: report.issue_corrections(report.issue_lists(fleet_issues(spark, sf))),
    oracle.query("SELECT * FROM all_corrections", "all_corrections"))
_register(
    "dedupe_corrections", lambda spark, sf: report.dedupe_corrections(fleet_issues(spark, sf)),
    oracle.query("SELECT * FROM first_corrections", "first_corrections"))
_register(
    "problems", lambda spark, sf: report.problems(fleet_issues(spark, sf)),
    oracle.query("SELECT * FROM problem_lines", "problem_lines"))
_register(
    "probable_causes", lambda spark, sf: report.probable_causes(fleet_issues(spark, sf)),
    oracle.query(f"SELECT {PER}, ord, text FROM cause_lines", "cause_lines"))
_register(
    "correction_plan", lambda spark, sf: report.correction_plan(fleet_issues(spark, sf)),
    oracle.query(f"SELECT {PER}, ord, text FROM plan_lines", "plan_lines"))
_register(
    "remediation_plan",
    lambda spark, sf: report.remediation_plan(fleet_issues(spark, sf)).select("dataset", "contract", "ord", "title", "check"),
    oracle.query(f"SELECT {PER}, ord, text AS title, \"check\" FROM fix_lines", "fix_lines"))
_register(
    "impacts", lambda spark, sf: report.impacts(fleet_issues(spark, sf)),
    oracle.query(f"SELECT {PER}, pos, text FROM impact_lines", "impact_lines"))

_SUMMARY = (
    "CASE WHEN status = 'PASS' THEN 'as agreed' ELSE concat('blocking: ', CAST(fail_count AS varchar), ', to note: ', "
    "CAST(warn_count AS varchar)) END")
_LABEL = "CASE status WHEN 'PASS' THEN 'accepted' WHEN 'WARN' THEN 'accepted with remarks' ELSE 'refused' END"
_register(
    "report_summary",
    lambda spark, sf: fleet_statuses(spark, sf).withColumn("label", report.status_label()).withColumn("summary", report.summary_text()),
    oracle.query(f"SELECT *, {_LABEL} AS label, {_SUMMARY} AS summary FROM states", "states"))


def _lines(source: str, each: str, between: str, order: str = "ord", where: str = "true") -> str:
    return (
        f"SELECT {PER}, string_agg({each}, {between} ORDER BY {order}) AS lines FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {PER} ORDER BY {order}) AS place FROM {source}) WHERE {where} GROUP BY {PER}")


_TOP = {"each": "concat(CAST(place AS varchar), ') ', text)", "between": "chr(10)", "where": "place <= 3"}
# where no check has a line in the plan, the suggestions of the corrections stand in for it
_ADVICE = (
    f"SELECT {PER}, ord, text FROM plan_lines UNION ALL SELECT {PER}, ord, suggestion FROM first_corrections "
    f"WHERE ({PER}) NOT IN (SELECT ({PER}) FROM plan_lines)")
_ABOUT = "concat('`', s.dataset, '` under `', s.contract, '`')"
_MESSAGE = (
    f"CASE WHEN status = 'PASS' THEN concat('Delivery accepted: ', {_ABOUT}, '.') ELSE concat('Delivery ', {_LABEL}, ': ', {_ABOUT}, "
    "chr(10), chr(10), 'What we found', chr(10), coalesce(p.lines, '1) departures from the contract'), chr(10), chr(10), "
    "'What we ask for', chr(10), coalesce(c.lines, '1) a delivery, or a contract, that fits'), chr(10), chr(10), "
    "'If this is how it is meant to be, tell us and we will change the contract together.') END")
_MESSAGE_PARTS = {
    "advice": _ADVICE, "top_problems": _lines("problem_lines", **_TOP), "top_plan": _lines("advice", **_TOP)}
_register(
    "supplier_messages",
    lambda spark, sf: fleet_reports(spark, sf).select("dataset", "contract", "supplier_message"),
    oracle.query(
        f"SELECT s.dataset, s.contract, {_MESSAGE} AS supplier_message FROM states s "
        f"LEFT JOIN top_problems p USING ({PER}) LEFT JOIN top_plan c USING ({PER})",
        "states", "problem_lines", "plan_lines", "first_corrections", **_MESSAGE_PARTS))


def _report_columns(reports: DataFrame) -> DataFrame:
    return reports.select(
        "dataset", "contract", "status", "fail_count", "warn_count", F.size("issues").cast("long").alias("issue_lines"),
        F.size("corrections").cast("long").alias("correction_count"), F.size("problems").cast("long").alias("problem_count"),
        F.size("causes").cast("long").alias("cause_count"), F.size("fixes").cast("long").alias("fix_count"),
        "explanation", "business_impact", "proposed_correction")


def _count(source: str, name: str) -> str:
    return f"(SELECT count(*) FROM {source} x WHERE x.dataset = s.dataset AND x.contract = s.contract) AS {name}"


def _report_sql(over: dict[str, str] | None = None) -> str:
    return oracle.query(
        f"""
        SELECT s.dataset, s.contract, s.status, s.fail_count, s.warn_count, {_count('merged', 'issue_lines')},
          {_count('first_corrections', 'correction_count')}, {_count('problem_lines', 'problem_count')},
          {_count('cause_lines', 'cause_count')}, {_count('fix_lines', 'fix_count')},
          CASE WHEN status = 'PASS' THEN concat({_ABOUT}, ': all as agreed.') ELSE concat(p.lines, '.') END AS explanation,
          CASE WHEN status = 'PASS' THEN 'None by the rules of the contract.'
            ELSE coalesce(i.lines || '.', 'Not known for these checks.') END AS business_impact,
          CASE WHEN status = 'PASS' THEN 'None.'
            ELSE coalesce(c.lines || '.', 'Mend the delivery, or agree on a new version of the contract.') END AS proposed_correction
        FROM states s LEFT JOIN every_problem p USING ({PER}) LEFT JOIN every_impact i USING ({PER}) LEFT JOIN every_plan c USING ({PER})
        """,
        "states", "problem_lines", "plan_lines", "cause_lines", "impact_lines", "fix_lines", "first_corrections", over=over, advice=_ADVICE,
        every_problem=_lines("problem_lines", "text", "'; '"), every_plan=_lines("advice", "text", "'; '"),
        every_impact=_lines("impact_lines", "text", "'; '", "pos"))


_register("validation_report", lambda spark, sf: _report_columns(fleet_reports(spark, sf)), _report_sql())

# -- every feed under two contracts ------------------------------------------------------------------------

_OVER = {"feeds": inputs.BOTH_FEEDS, "deliveries": inputs.BOTH_DELIVERIES}


def _both(spark: SparkSession, sf_dir: str):
    """(assignments, rules, received), and the delivered rows once under each of their dataset's contracts."""
    assignments = inputs.both(inputs.feeds(spark, sf_dir))
    rows = inputs.deliveries(spark, sf_dir).drop("contract").join(assignments, "dataset")
    return (assignments, inputs.rules(spark), inputs.feed_columns(spark, sf_dir)), rows


def report_two_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet, rows = _both(spark, sf_dir)
    totals = row_issues.cell_totals(rows, inputs.CONTRACTS, F.col("row"), F.col("dataset"), "contract")
    return _report_columns(report.validation_report(fleet[0], validate.merged_issues(*fleet, totals)))


def gate_two_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleet, rows = _both(spark, sf_dir)
    bad = row_issues.bad_cell_counts(rows, inputs.CONTRACTS, F.col("dataset"), "contract")
    return gate.gate(validate.statuses(*fleet, bad))


_register("report_two_contracts", report_two_contracts, _report_sql(_OVER))
_register("gate_two_contracts", gate_two_contracts, oracle.query(
    "SELECT *, CASE WHEN status = 'FAIL' THEN 'block' ELSE 'allow' END AS decision FROM states", "states", over=_OVER))

oracle.PARTS["costs"] = """
    SELECT f.dataset, f.contract, coalesce(s.n, 0) AS source_columns, coalesce(c.n, 0) AS contract_columns,
      coalesce(d.n, 0) AS data_rows,
      coalesce(s.n, 0) * coalesce(c.n, 0) + coalesce(d.n, 0) * coalesce(c.n, 0) AS estimated_units
    FROM feeds f LEFT JOIN (SELECT dataset, count(*) AS n FROM feed_columns GROUP BY dataset) s USING (dataset)
      LEFT JOIN (SELECT contract, count(*) AS n FROM rules GROUP BY contract) c USING (contract)
      LEFT JOIN (SELECT dataset, count(*) AS n FROM deliveries GROUP BY dataset) d USING (dataset)"""
oracle.NEEDS["costs"] = ["feeds", "rules", "feed_columns", "deliveries"]


# -- sinks ---------------------------------------------------------------------------------------------


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines, read back, and taken apart again."""
    path = work_folder(spark, "reports")
    sinks.write_documents(sinks.report_json(fleet_reports(spark, sf_dir), fleet_costs(spark, sf_dir), "trace-1"), path)
    stored = spark.read.schema("dataset string, contract string, json string").json(path)

    def at(place: str):
        return F.get_json_object("json", place)

    def size(place: str):
        return F.json_array_length(at(place)).cast("long")

    return stored.select(
        "dataset", "contract", at("$.source").alias("source"), at("$.status").alias("status"),
        at("$.counts.FAIL").cast("long").alias("fails"), at("$.counts.WARN").cast("long").alias("warns"),
        size("$.issues").alias("issues"), size("$.corrections").alias("corrections"), size("$.analysis.problems").alias("problems"),
        size("$.recommendations").alias("recommendations"), size("$.fixes").alias("fixes"),
        at("$.issues[0].check").alias("first_check"), at("$.issues[0].column").alias("first_column"),
        at("$.issues[0].expected").alias("first_expected"), at("$.issues[0].actual").alias("first_actual"),
        at("$.texts.supplierMessage").alias("message"), at("$.trace").alias("trace"), at("$.cost.estimated_units").cast("long").alias("units"),
    )


_register("report_json", report_json, oracle.query(
    f"""
    SELECT s.dataset, s.contract, s.dataset AS source, s.status, s.fail_count AS fails, s.warn_count AS warns, {_count('merged', 'issues')},
      {_count('first_corrections', 'corrections')}, {_count('problem_lines', 'problems')}, {_count('plan_lines', 'recommendations')},
      {_count('fix_lines', 'fixes')}, m."check" AS first_check, m."column" AS first_column,
      coalesce(m.expected, '["' || replace(m.domain, ', ', '","') || '"]') AS first_expected, m.actual AS first_actual,
      {_MESSAGE} AS message, 'trace-1' AS trace, k.estimated_units AS units
    FROM states s LEFT JOIN (SELECT * FROM merged WHERE ord = 1) m USING ({PER})
      LEFT JOIN top_problems p USING ({PER}) LEFT JOIN top_plan c USING ({PER}) LEFT JOIN costs k USING ({PER})
    """, "states", "problem_lines", "plan_lines", "first_corrections", "fix_lines", "costs", **_MESSAGE_PARTS))


def _cell(value: str) -> str:
    return f"regexp_replace(replace(coalesce({value}, ''), '|', '\\|'), '[ \\t\\n\\r\\f]+', ' ', 'g')"


def _row(*cells: str) -> str:
    return "concat('| ', concat_ws(' | ', " + ", ".join(cells) + "), ' |')"


def _part(title: str, name: str, head: str = "") -> str:
    return f"coalesce({quote(chr(10) * 2 + '## ' + title + chr(10) * 2 + head)} || {name}.lines, '')"


_HEADS = {n: f"| {' | '.join(cells)} |\n|{' -- |' * len(cells)}\n" for n, cells in [
    ("k", ["action", "target", "how"]), ("m", ["no.", "severity", "check", "column", "what", "agreed", "found", "row", "effect"])]}
_BULLET = {"each": "'* ' || text", "between": "chr(10)"}
_register(
    "report_markdown", lambda spark, sf: sinks.report_markdown(fleet_reports(spark, sf)),
    oracle.query(
        f"""
        SELECT s.dataset, s.contract, concat('# `', s.dataset, '`: ', {_LABEL}, chr(10), chr(10), 'Checked against `', s.contract,
          '`. Status ', status, ' (', {_SUMMARY}, ').', {_part('In short', 'p')}, {_part('Likely origin', 'o')}, {_part('Consequences', 'i')},
          {_part('Next steps', 'c')}, {_part('Corrections', 'k', _HEADS['k'])}, {_part('Runnable', 'f')},
          {_part('Findings', 'm', _HEADS['m'])}) AS markdown
        FROM states s LEFT JOIN p USING ({PER}) LEFT JOIN o USING ({PER}) LEFT JOIN i USING ({PER})
          LEFT JOIN c USING ({PER}) LEFT JOIN m USING ({PER}) LEFT JOIN k USING ({PER}) LEFT JOIN f USING ({PER})
        """,
        "states", "problem_lines", "plan_lines", "cause_lines", "impact_lines", "fix_lines", "first_corrections",
        p=_lines("problem_lines", **_BULLET), o=_lines("cause_lines", **_BULLET), i=_lines("impact_lines", **_BULLET, order="pos"),
        c=_lines("plan_lines", **_BULLET), f=_lines("fix_lines", **_BULLET),
        k=_lines("first_corrections", _row("action", _cell("target"), _cell("suggestion")), "chr(10)"),
        m=_lines("merged", _row(
            "CAST(ord AS varchar)", "severity", '"check"', _cell('"column"'), _cell(SQL_MESSAGE), _cell("coalesce(domain, expected)"),
            _cell("actual"), "coalesce(CAST(\"row\" AS varchar), '')", _cell(SQL_EFFECT)), "chr(10)")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended to a log as JSON lines and read back."""
    path = work_folder(spark, "alerts")
    sinks.append_alerts(sinks.alerts(fleet_reports(spark, sf_dir), "data-quality"), path)
    return spark.read.schema("channel string, title string, text string").json(path)


_register("alerts", alerts, oracle.query(
    f"SELECT 'data-quality' AS channel, concat('FAIL ', s.dataset, ' / ', s.contract) AS title, {_MESSAGE} AS text FROM states s "
    f"LEFT JOIN top_problems p USING ({PER}) LEFT JOIN top_plan c USING ({PER}) WHERE status = 'FAIL'",
    "states", "problem_lines", "plan_lines", "first_corrections", **_MESSAGE_PARTS))

# -- budgets, gate, history, cases -----------------------------------------------------------------------


def fleet_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inputs.deliveries(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("data_rows"))
    return gate.cost_units(
        inputs.feeds(spark, sf_dir), inputs.rules(spark), inputs.feed_columns(spark, sf_dir), counts)


_register("cost_units", fleet_costs, oracle.query("SELECT * FROM costs", "costs"))
_register(
    "budget_check",
    lambda spark, sf: gate.budget_check(fleet_costs(spark, sf), max_columns=7, max_contract_columns=6, max_data_rows=10),
    oracle.query(
        "SELECT *, CASE WHEN source_columns > 7 THEN 'source_columns' WHEN contract_columns > 6 THEN 'contract_columns' "
        "WHEN data_rows > 10 THEN 'data_rows' END AS breach FROM costs", "costs"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended to the history table and read back; the append measures itself."""
    path = work_folder(spark, "runs")
    runs = sinks.run_history(fleet_reports(spark, sf_dir), fleet_costs(spark, sf_dir), "trace-1")
    sinks.append_runs(runs, path)
    return spark.read.parquet(path).select("trace_id", "status", "source", "contract", "issue_count", "estimated_units")


_register("run_history", run_history, oracle.query(
    f"SELECT 'trace-1' AS trace_id, status, s.dataset AS source, s.contract, fail_count + warn_count AS issue_count, "
    f"estimated_units FROM states s JOIN costs c USING ({PER})", "states", "costs"))

for _name, _strict in [("gate", False), ("gate_strict", True)]:
    _register(
        _name,
        lambda spark, sf, strict=_strict: gate.gate(fleet_statuses(spark, sf).select("dataset", "contract", "status"), fail_on_warning=strict),
        oracle.query(
            "SELECT dataset, contract, status, CASE WHEN status "
            + ("<> 'PASS'" if _strict else "= 'FAIL'") + " THEN 'block' ELSE 'allow' END AS decision FROM states",
            "states"))

# what a case expects depends on how its feed drifts: a third of the feeds keeps to its contract
_KINDS = [
    ("customer % 3 = 2", "PASS", [], []),
    ("customer % 2 = 0", "FAIL", ["column.renamed", "value.format"], ["RENAME_SOURCE_COLUMN", "NORMALIZE_DATE_FORMAT"]),
    ("customer % 2 = 1", "FAIL", ["type.change", "value.type", "value.min"], ["CAST_SOURCE_COLUMN", "ENFORCE_MIN_VALUE"]),
]


def evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One golden case per feed, of three kinds; some fail, which is what the query shows."""
    def choose(make):
        choice = F
        for where, *expected in _KINDS:
            choice = choice.when(F.expr(where), make(*expected))
        return choice

    def texts(items):
        return F.array(*map(F.lit, items)).cast("array<string>")

    cases = inputs.feeds(spark, sf_dir).withColumn("customer", F.substring("dataset", 6, 20).cast("long")).select(
        F.concat(F.lit("case "), "dataset").alias("name"), "dataset", "contract",
        choose(lambda status, checks, actions: F.lit(status)).alias("expected_status"),
        choose(lambda status, checks, actions: texts(checks)).alias("expected_checks"),
        choose(lambda status, checks, actions: texts(actions)).alias("expected_corrections"),
    )
    results = gate.evaluate_cases(cases, fleet_reports(spark, sf_dir))
    return results.select("name", "passed", F.array_join("failures", "; ").alias("failures"))


def _miss(where: str, status: str, checks: list[str], actions: list[str]) -> str:
    misses = [
        f"CASE WHEN status <> '{status}' THEN concat('status expected {status} got ', status) END",
        *[f"CASE WHEN NOT list_contains(coalesce(checks, []), {quote(c)}) THEN {quote('missing check ' + c)} END" for c in checks],
        *[f"CASE WHEN NOT list_contains(coalesce(actions, []), {quote(a)}) THEN {quote('missing correction ' + a)} END" for a in actions],
    ]
    return f"WHEN {where} THEN concat_ws('; ', {', '.join(misses)})"


_register("evaluate_cases", evaluate_cases, oracle.query(
    f"SELECT name, failures = '' AS passed, failures FROM (SELECT concat('case ', dataset) AS name, CASE {' '.join(_miss(*k) for k in _KINDS)} END "
    f"AS failures FROM (SELECT *, CAST(substr(dataset, 6) AS bigint) AS customer FROM states) "
    f"LEFT JOIN (SELECT {PER}, list(DISTINCT \"check\") AS checks FROM merged GROUP BY {PER}) m USING ({PER}) "
    f"LEFT JOIN (SELECT {PER}, list(DISTINCT action) AS actions FROM all_corrections GROUP BY {PER}) a USING ({PER}))",
    "states", "all_corrections"))

# -- several tables, each with its own contract, in one plan ---------------------------------------------


def _members(spark: SparkSession, sf_dir: str):
    def member(name, contract, key):
        return name, inputs.table(spark, sf_dir, name), contract, F.col(key) + 2

    return [
        member("customer", inputs.CUSTOMER, "c_custkey"), member("orders", inputs.ORDERS, "o_orderkey"),
        member("events", inputs.EVENTS, "event_id"),
    ]


def validate_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = validate.validate_fleet(spark, _members(spark, sf_dir))
    issues = reports.select("dataset", "contract", "status", F.posexplode("issues").alias("n", "i"))
    return issues.select("dataset", "contract", "status", "n", "i.severity", "i.check", "i.column", "i.expected",
                         "i.row")


def _typed_cells(contract, name: str, key: str) -> str:
    return oracle.cells_sql(
        contract, f"(SELECT '{name}' AS dataset, {key} + 2 AS \"row\", * FROM {name})",
        {r.column for r in contract.rules}, text=False)


_register("validate_fleet", validate_fleet, oracle.query(
    """
    SELECT dataset, contract, 'FAIL' AS status, row_number() OVER (PARTITION BY dataset ORDER BY part, n) - 1 AS n,
      severity, "check", "column", expected, "row"
    FROM (
      SELECT dataset, contract, 1 AS part, n, 'FAIL' AS severity, "check", "column", expected, '' AS actual, "row"
        FROM totals
      UNION ALL SELECT * FROM schema_part)
    """,
    cells=_typed_cells(inputs.CUSTOMER, "customer", "c_custkey") + " UNION ALL "
    + _typed_cells(inputs.ORDERS, "orders", "o_orderkey") + " UNION ALL "
    + _typed_cells(inputs.EVENTS, "events", "event_id"),
    totals="""
      SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos, "check" = 'value.required', "row", "check") AS n
      FROM (SELECT dataset, contract, pos, "check", "column", any_value(expected) AS expected, min("row") AS "row"
        FROM cells GROUP BY dataset, contract, pos, "check", "column")""",
    schema_part="""
      SELECT 'customer' AS dataset, 'customer_contract' AS contract, 0 AS part, 0 AS n, 'WARN' AS severity,
        'column.extra' AS "check", 'c_nationkey' AS "column", NULL AS expected, 'long' AS actual, NULL AS "row"
      UNION ALL
      SELECT 'events', 'events_contract', 0, 0, 'WARN', 'type.promotion', 'user_id', 'int', 'long', NULL"""))


def budget_before_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that keep to the row limit are validated, the others only named."""
    limit = inputs.table(spark, sf_dir, "events").count()
    members, costs = validate.within_budget(spark, _members(spark, sf_dir), max_data_rows=limit)
    counts = validate.fleet_counts(members).groupBy("dataset").agg(F.sum("violations").alias("violations"))
    return costs.join(counts, "dataset", "left").select("dataset", "data_rows", "breach", "violations")


_register("budget_before_scan", budget_before_scan, oracle.query(
    "SELECT dataset, data_rows, CASE WHEN data_rows > (SELECT count(*) FROM events) THEN 'data_rows' END AS breach, "
    "CASE WHEN data_rows <= (SELECT count(*) FROM events) THEN violations END AS violations FROM sizes LEFT JOIN "
    "(SELECT dataset, count(*) AS violations FROM cells GROUP BY dataset) USING (dataset)",
    sizes=" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS data_rows FROM {t}" for t in ("customer", "orders", "events")),
    cells=_typed_cells(inputs.CUSTOMER, "customer", "c_custkey") + " UNION ALL "
    + _typed_cells(inputs.ORDERS, "orders", "o_orderkey") + " UNION ALL "
    + _typed_cells(inputs.EVENTS, "events", "event_id")))


def fleet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.fleet_counts(_members(spark, sf_dir)).select("dataset", "column", "check", "violations")


_register("validate_fleet_counts", fleet_counts, oracle.query(
    'SELECT dataset, "column", "check", count(*) AS violations FROM cells GROUP BY ALL',
    cells=_typed_cells(inputs.CUSTOMER, "customer", "c_custkey") + " UNION ALL "
    + _typed_cells(inputs.ORDERS, "orders", "o_orderkey") + " UNION ALL "
    + _typed_cells(inputs.EVENTS, "events", "event_id")))
