"""Row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions import text
from pactum.operators import cell_checks, profile, report, row_issues
from pactum.session import work_folder
from pactum.types import Contract, Rule
from workload import inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}
ROW, DATASET = F.col, F.col


def _single(name: str, rule: Rule, oracle_where: str) -> None:
    """One rule on one column of deliveries: the cells that break it."""
    check = {
        "check_allowed": fixed.ALLOWED, "check_pattern": fixed.PATTERN, "check_format": fixed.FORMAT,
        "check_min": fixed.MINIMUM, "check_max": fixed.MAXIMUM,
    }.get(name, fixed.VALUE_TYPE)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        issues = row_issues.row_issues(
            inputs.deliveries(spark, sf_dir), [Contract("one_rule", [rule])], F.col("row"), F.col("dataset")
        )
        return issues.filter(F.col("check") == check).select(
            "dataset", "row", "column", F.array_join("expected_values", ",").alias("domain"), "expected", "actual"
        )

    v = oracle.STRIP.format(v=rule.column)
    domain = oracle.quote(",".join(rule.allowed_values)) if rule.allowed_values else "NULL"
    expected = "NULL" if rule.allowed_values else oracle.quote(cell_checks.expected_text(rule, check))
    QUERIES[name] = run
    ORACLES[name] = oracle.query(
        f'SELECT dataset, "row", {oracle.quote(rule.column)} AS "column", CAST({domain} AS varchar) AS domain, '
        f"CAST({expected} AS varchar) AS expected, {oracle.REDACTED.format(v=v)} AS actual "
        f"FROM deliveries WHERE {v} <> '' AND {oracle_where.format(v=v)}",
        "deliveries",
    )


_single("check_allowed", Rule("priority", "string", allowed_values=["1-URGENT", "2-HIGH", "5-LOW"]),
        "{v} NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
_single("check_pattern", Rule("mail", "string", pattern=inputs.EMAIL_PATTERN),
        f"NOT regexp_full_match({{v}}, '{inputs.EMAIL_PATTERN}')")
_single("check_format", Rule("birth_date", "date", format="%Y-%m-%d"), "try_strptime({v}, '%Y-%m-%d') IS NULL")
_number = "try_cast(replace({v}, '_', '') AS double)"
_single("check_min", Rule("amount", "decimal", min_value="0.5"),
        f"{oracle.type_ok('decimal', '{v}').replace('{v}', '{v}')} AND {_number} < 0.5 AND NOT isnan({_number})")
_single("check_max", Rule("amount", "double", max_value="250000.25"),
        f"{oracle.type_ok('double', '{v}')} AND {_number} > 250000.25 AND NOT isnan({_number})")
for _name, _column, _kind in [
    ("check_type_int", "customer_id", "int"), ("check_type_double", "amount", "double"),
    ("check_type_decimal", "amount", "decimal"), ("check_type_boolean", "opt_in", "boolean"),
    ("check_type_date", "birth_date", "date"), ("check_type_timestamp", "seen_at", "timestamp"),
]:
    _single(_name, Rule(_column, _kind), "NOT " + oracle.type_ok(_kind, "{v}").replace("{4}", "{{4}}").replace(
        "{2}", "{{2}}"))


def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.deliveries(spark, sf_dir).filter(
        text.is_blank(F.col("customer_id")) | text.is_blank(F.col("mail"))
    ).select("row", text.is_blank(F.col("customer_id")).alias("blank_id"), text.is_blank(F.col("mail")).alias("blank_mail"))


QUERIES["blank_cells"] = blank_cells
_blank = lambda c: f"({c} IS NULL OR {oracle.STRIP.format(v=c)} = '')"
ORACLES["blank_cells"] = oracle.query(
    f'SELECT "row", {_blank("customer_id")} AS blank_id, {_blank("mail")} AS blank_mail FROM deliveries '
    f'WHERE {_blank("customer_id")} OR {_blank("mail")}', "deliveries")


def check_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_issues.required_issues(
        inputs.deliveries(spark, sf_dir), [inputs.DELIVERY], F.col("row"), F.col("dataset")
    ).select("dataset", "column", "row", "expected", "actual")


QUERIES["check_required"] = check_required
ORACLES["check_required"] = oracle.query(
    'SELECT dataset, "column", min("row") AS "row", \'non-empty value\' AS expected, '
    "concat(CAST(count(*) AS varchar), ' empty values') AS actual FROM delivery_cells "
    "WHERE \"check\" = 'value.required' GROUP BY dataset, \"column\"", "delivery_cells")


def row_check_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every row's cells."""
    return row_issues.first_failures(inputs.deliveries(spark, sf_dir), inputs.DELIVERY, ["row"])


QUERIES["row_check_first_failure"] = row_check_first_failure
ORACLES["row_check_first_failure"] = oracle.query(
    'SELECT "row", ' + ", ".join(
        f"{oracle.cell_case(r, r.column)} AS check_{r.column}" for r in inputs.DELIVERY.rules
    ) + " FROM deliveries", "deliveries")


def all_row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_issues.row_issues(
        inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("row"), F.col("dataset"), "contract"
    ).select("dataset", "contract", "row", "pos", "severity", "check", "column", "expected",
             F.array_join("expected_values", ", ").alias("domain"), "actual")


QUERIES["row_issues"] = all_row_issues
ORACLES["row_issues"] = oracle.query(
    'SELECT dataset, contract, "row", pos, \'FAIL\' AS severity, "check", "column", expected, domain, '
    f"{oracle.REDACTED.format(v='v')} AS actual FROM fleet_cells", "fleet_cells")


def lineitem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on the largest table, in its own types."""
    return row_issues.violation_counts(
        inputs.table(spark, sf_dir, "lineitem"), [inputs.LINEITEM], F.lit("lineitem")
    ).select("dataset", "column", "check", "violations")


QUERIES["violation_counts"] = lineitem_counts
ORACLES["violation_counts"] = oracle.query(
    'SELECT dataset, "column", "check", count(*) AS violations FROM cells GROUP BY ALL',
    cells=oracle.cells_sql(
        inputs.LINEITEM, "(SELECT 'lineitem' AS dataset, * FROM lineitem)",
        {r.column for r in inputs.LINEITEM.rules}, text=False, keep="dataset"))


def fleet_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_issues.violation_counts(
        inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("dataset"), "contract"
    ).select("dataset", "column", "check", "violations")


QUERIES["violation_counts_fleet"] = fleet_violation_counts
ORACLES["violation_counts_fleet"] = oracle.query(
    'SELECT dataset, "column", "check", count(*) AS violations FROM fleet_cells GROUP BY ALL', "fleet_cells")


def issue_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_issues.issue_sample(
        inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("row"), F.col("dataset"), "contract"
    ).select("dataset", "n", "severity", "check", "column", "expected", "actual", "row")


QUERIES["issue_sample"] = issue_sample
ORACLES["issue_sample"] = oracle.query(
    'SELECT dataset, n, severity, "check", "column", expected, actual, "row" FROM fleet_sample', "fleet_sample")


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact findings of every feed, uncapped."""
    issues = row_issues.issue_summary(
        inputs.deliveries(spark, sf_dir), inputs.CONTRACTS, F.col("row"), F.col("dataset"), "contract")
    return issues.select("dataset", "contract", "check", "column", "expected", "actual", "row", "n")


QUERIES["issue_summary"] = issue_summary
ORACLES["issue_summary"] = oracle.query(
    'SELECT dataset, contract, "check", "column", any_value(expected) AS expected, '
    "CASE WHEN \"check\" = 'value.required' THEN concat(CAST(count(*) AS varchar), ' empty values') "
    f"ELSE arg_min({oracle.REDACTED.format(v='v')}, \"row\") END AS actual, min(\"row\") AS \"row\", count(*) AS n "
    'FROM fleet_cells GROUP BY dataset, contract, "check", "column"', "fleet_cells")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped report of the whole deliveries table taken as one dataset."""
    issues = row_issues.quality_report(
        inputs.deliveries(spark, sf_dir), [inputs.DELIVERY], F.col("row"), F.lit("deliveries")
    )
    return issues.select("dataset", "contract", "ord", "severity", "check", "column", "expected", "actual", "row")


QUERIES["quality_report"] = quality_report
ORACLES["quality_report"] = oracle.query(
    """
    SELECT 'deliveries' AS dataset, 'delivery_contract' AS contract, ord, severity, "check", "column", expected,
      actual, "row" FROM (
      SELECT n AS ord, 'FAIL' AS severity, "check", "column", expected, actual, "row" FROM firsts
      UNION ALL
      SELECT 21, 'WARN', 'quality.issue_limit', '*', 'at most 20 sampled issues', '20 sampled issues', NULL
        FROM firsts WHERE n = 20)
    """, "delivery_cells",
    candidates=f"""
      SELECT pos, 0 AS late, "row", "check", "column", expected, {oracle.REDACTED.format(v='v')} AS actual
        FROM delivery_cells WHERE "check" <> 'value.required'
      UNION ALL
      SELECT pos, 1, min("row"), 'value.required', "column", 'non-empty value',
        concat(CAST(count(*) AS varchar), ' empty values')
        FROM delivery_cells WHERE "check" = 'value.required' GROUP BY pos, "column"
      """,
    firsts='SELECT *, row_number() OVER (ORDER BY pos, late, "row") AS n FROM candidates QUALIFY n <= 20')


def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


QUERIES["redact_values"] = redact_values
ORACLES["redact_values"] = f"SELECT doc_id, {oracle.REDACTED.format(v='text')} AS redacted FROM documents"


def redact_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.deliveries(spark, sf_dir).select("row", text.redact(F.col("mail")).alias("redacted"))


QUERIES["redact_mail"] = redact_mail
ORACLES["redact_mail"] = oracle.query(
    f"SELECT \"row\", {oracle.REDACTED.format(v='mail')} AS redacted FROM deliveries", "deliveries")


def many_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table whose rows fall under hundreds of contracts: the violations of each, from one scan."""
    number = F.substring("dataset", 6, 20).cast("long") % inputs.MANY
    df = inputs.deliveries(spark, sf_dir).withColumn("contract", F.concat(F.lit("rules-"), number.cast("string")))
    contracts = [inputs.numbered_contract(k) for k in range(inputs.MANY)]
    return row_issues.violation_counts(df, contracts, F.lit("deliveries"), "contract").select(
        "contract", "pos", "column", "check", "violations")


def _many(column: str, pos: str, *cases: str, where: str = "true") -> str:
    v = oracle.STRIP.format(v=column)
    whens = " ".join(f"WHEN {c}" for c in cases).replace("{v}", v)
    return (
        f"SELECT k, {pos} AS pos, '{column}' AS \"column\", CASE {whens} END AS \"check\" FROM d WHERE {where}"
    )


_blank, _num = "coalesce({v}, '') = ''", "try_cast(replace({v}, '_', '') AS double)"
QUERIES["many_contracts"] = many_contracts
ORACLES["many_contracts"] = oracle.query(
    "SELECT 'rules-' || k AS contract, CAST(pos AS integer) AS pos, \"column\", \"check\", count(*) AS violations FROM ("
    + " UNION ALL ".join([
        _many("customer_id", "0", f"{_blank} THEN CASE WHEN k % 2 = 1 THEN 'value.required' END",
              f"NOT {oracle.type_ok('long', '{v}')} THEN 'value.type'", f"{_num} < 1 + k % 3 THEN 'value.min'"),
        _many("mail", "1", f"{_blank} THEN CASE WHEN k % 4 = 0 THEN 'value.required' END",
              f"NOT regexp_full_match({{v}}, '{inputs.EMAIL_PATTERN}') THEN 'value.pattern'"),
        _many("birth_date", "2", f"{_blank} THEN NULL",
              "k % 3 = 0 THEN CASE WHEN try_strptime({v}, '%Y-%m-%d') IS NULL THEN 'value.format' END",
              f"NOT {oracle.type_ok('date', '{v}')} THEN 'value.type'"),
        _many("amount", "3", f"{_blank} THEN NULL", f"NOT {oracle.type_ok('double', '{v}')} THEN 'value.type'",
              f"isnan({_num}) THEN 'value.type'", f"{_num} < 0 THEN 'value.min'", f"{_num} > 100000 + 10000 * (k % 30) THEN 'value.max'"),
        _many("opt_in", "4", f"{_blank} THEN 'value.required'", f"NOT {oracle.type_ok('boolean', '{v}')} THEN 'value.type'", where="k % 5 <> 0"),
        _many("priority", "CASE WHEN k % 5 = 0 THEN 4 ELSE 5 END", f"{_blank} THEN NULL",
              "{v} = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][k % 5 + 1] THEN 'value.allowed'"),
    ]) + ") WHERE \"check\" IS NOT NULL GROUP BY ALL",
    "deliveries", d=f"SELECT * EXCLUDE (k), CAST(substr(dataset, 6) AS bigint) % {inputs.MANY} AS k FROM deliveries")


# -- uniqueness, profile, naming of columns is in schema.py ------------------------------------------


def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_keys(inputs.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


QUERIES["check_unique"] = check_unique
ORACLES["check_unique"] = (
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL "
    "AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")


UNIQUE = Contract("unique_contract", [Rule("mail", "string", unique=True), Rule("customer_id", "string", unique=True), Rule("priority")])


def unique_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated values of each feed's columns that must be unique."""
    return row_issues.unique_totals(inputs.deliveries(spark, sf_dir), [UNIQUE], F.col("row"), F.col("dataset")).select(
        "dataset", "column", "check", "severity", "n", "row", "actual")


QUERIES["unique_issues"] = unique_issues
ORACLES["unique_issues"] = oracle.query(
    "SELECT dataset, \"column\", 'value.unique' AS \"check\", 'FAIL' AS severity, CAST(sum(n) AS bigint) AS n, min(\"row\") AS \"row\", "
    "concat(CAST(CAST(sum(n) AS bigint) AS varchar), ' cells with shared values') AS actual FROM (SELECT dataset, \"column\", v, count(*) AS n, "
    "min(\"row\") AS \"row\" FROM cells WHERE v <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset, \"column\"",
    "deliveries", cells=" UNION ALL ".join(
        f"SELECT dataset, \"row\", '{c}' AS \"column\", {oracle.STRIP.format(v=c)} AS v FROM deliveries" for c in ("mail", "customer_id")))


def profile_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(
        inputs.deliveries(spark, sf_dir), ["customer_id", "mail", "birth_date", "amount", "opt_in", "seen_at", "priority"]
    )


QUERIES["profile_columns"] = profile_deliveries
_v = oracle.STRIP.format(v="value")
ORACLES["profile_columns"] = oracle.query(
    f"SELECT \"column\", count(*) AS row_count, count(*) FILTER (value IS NULL OR {_v} = '') AS blank_count, "
    f"count(DISTINCT value) FILTER ({_v} <> '') AS distinct_count, min(value) FILTER ({_v} <> '') AS min_value, "
    f"max(value) FILTER ({_v} <> '') AS max_value FROM cells GROUP BY ALL", "deliveries",
    cells=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value FROM deliveries"
        for c in ["customer_id", "mail", "birth_date", "amount", "opt_in", "seen_at", "priority"]))


def profile_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of each priority's rows, stored as sketches and added up; the estimates beside the exact number."""
    df = inputs.deliveries(spark, sf_dir)
    columns = ["customer_id", "mail", "amount", "opt_in"]
    path = work_folder(spark, "profiles")
    profile.profile_sketches(df, columns, ["priority"]).write.parquet(path)
    merged = profile.read_profiles(profile.merge_profiles(spark.read.parquet(path)), [0.5])
    exact = profile.profile_columns(df, columns).select("column", F.col("distinct_count").alias("exact"))
    amounts = df.select(F.col("amount").try_cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").agg(
        F.expr("percentile(v, 0.45)").alias("low"), F.expr("percentile(v, 0.55)").alias("high")).withColumn("column", F.lit("amount"))
    middle = merged.join(amounts, "column").select("column", F.expr("q50 BETWEEN low AND high").alias("is_middle"))
    return merged.join(exact, "column").join(middle, "column", "left").select(
        "column", "row_count", "blank_count", "min_value", "max_value",
        (F.abs(F.col("distinct_count") / F.col("exact") - 1) < 0.06).alias("distinct_is_near"), "is_middle")


QUERIES["profile_sketches"] = profile_by_priority
ORACLES["profile_sketches"] = oracle.query(
    f"SELECT \"column\", count(*) AS row_count, count(*) FILTER (value IS NULL OR {_v} = '') AS blank_count, "
    f"min(value) FILTER ({_v} <> '') AS min_value, max(value) FILTER ({_v} <> '') AS max_value, true AS distinct_is_near, "
    "CASE WHEN \"column\" = 'amount' THEN true END AS is_middle FROM cells GROUP BY \"column\"", "deliveries",
    cells=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM deliveries" for c in ["customer_id", "mail", "amount", "opt_in"]))


def customer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact violations of the customer table, and the status that follows from them."""
    counts = row_issues.violation_counts(
        inputs.table(spark, sf_dir, "customer"), [inputs.CUSTOMER], F.lit("customer")
    ).withColumn("severity", F.lit(fixed.FAIL)).withColumn("n", F.col("violations"))
    assigned = spark.range(1).select(F.lit("customer").alias("dataset"), F.lit(inputs.CUSTOMER.name).alias("contract"))
    states = report.status_counts(assigned, counts)
    return states.join(counts, ["dataset", "contract"], "left").select(
        "dataset", "status", "fail_count", "column", "check", "violations", "severity")


QUERIES["customer_contract"] = customer_contract
ORACLES["customer_contract"] = oracle.query(
    'SELECT \'customer\' AS dataset, CASE WHEN total > 0 THEN \'FAIL\' ELSE \'PASS\' END AS status, total AS fail_count, "column", "check", violations, '
    'CASE WHEN violations IS NOT NULL THEN \'FAIL\' END AS severity FROM (SELECT count(*) AS total FROM cells) '
    'LEFT JOIN (SELECT "column", "check", count(*) AS violations FROM cells GROUP BY ALL) ON true',
    cells=oracle.cells_sql(
        inputs.CUSTOMER, "(SELECT 'customer' AS dataset, * FROM customer)",
        {r.column for r in inputs.CUSTOMER.rules}, text=False, keep="dataset"))
