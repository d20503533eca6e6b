"""Whole reports of the fixture pairs, issue by issue."""

import pytest
from pyspark.sql import functions as F

from fixtures import C1, C2, C3, C4, F1, F2, F3, F4, F5, rows_frame
from pactum.operators import gate, report, row_issues
from pactum.plans import validate
from pactum.sources import schemas
from pactum.types import ASSIGNMENTS, COLUMNS_META, rules_frame

MAILED = ["customer_id", "mail", "birth_date", "amount"]


def declared(spark, name, columns):
    return spark.createDataFrame([(name, n, c, t, False) for n, (c, t) in enumerate(columns)], COLUMNS_META)


def issues_of(df):
    rows = df.orderBy("ord").collect()
    return [(r["severity"], r["check"], r["column"], r["row"]) for r in rows]


def csv_issues(spark, name, rows, columns, contract):
    df = rows_frame(spark, rows, columns)
    received = schemas.infer_types(df.drop("row"), dataset=F.lit(name))
    return validate.dataset_issues(spark, name, df, contract, F.col("row"), received, cap=20)


def corrections_of(issues):
    rows = report.dedupe_corrections(report.issue_corrections(issues)).orderBy("ord").collect()
    return [(r["action"], r["target"]) for r in rows]


def test_declared_schema_against_profile_contract(spark):
    issues = validate.dataset_issues(spark, "F1", None, C1, received=declared(spark, "F1", F1))
    assert issues_of(issues) == [
        ("FAIL", "type.change", "customer_id", None), ("FAIL", "column.missing", "signup_ts", None),
        ("WARN", "column.missing", "country", None), ("WARN", "column.extra", "created_at", None),
        ("WARN", "column.extra", "marketing_opt_in", None),
    ]
    assert corrections_of(issues) == [
        ("CAST_SOURCE_COLUMN", "customer_id"), ("ADD_SOURCE_COLUMN", "signup_ts"), ("ADD_SOURCE_COLUMN", "country"),
        ("ADD_CONTRACT_COLUMN", "created_at"), ("ADD_CONTRACT_COLUMN", "marketing_opt_in"),
    ]


def test_customers_file(spark):
    issues = csv_issues(spark, "F2", F2, MAILED, C2)
    fails = [
        ("type.change", "customer_id", None), ("column.renamed", "email", None), ("type.change", "birth_date", None),
        ("type.change", "amount", None), ("value.type", "customer_id", 5), ("value.required", "customer_id", 2),
        ("value.format", "birth_date", 2), ("value.format", "birth_date", 5), ("value.format", "birth_date", 6),
        ("value.min", "amount", 3), ("value.min", "amount", 4), ("value.type", "amount", 5), ("value.min", "amount", 7),
        ("value.min", "amount", 8),
    ]
    assert issues_of(issues) == [("FAIL", *f) for f in fails]
    required = issues.filter("check = 'value.required'").first()
    assert required["message"].startswith("4 ") and required["actual"] == "4 empty values"
    assert corrections_of(issues) == [
        ("CAST_SOURCE_COLUMN", "customer_id"), ("RENAME_SOURCE_COLUMN", "mail"), ("CAST_SOURCE_COLUMN", "birth_date"),
        ("CAST_SOURCE_COLUMN", "amount"), ("CAST_OR_CLEAN_VALUE", "customer_id"),
        ("FILL_REQUIRED_VALUE", "customer_id"), ("NORMALIZE_DATE_FORMAT", "birth_date"),
        ("ENFORCE_MIN_VALUE", "amount"), ("CAST_OR_CLEAN_VALUE", "amount"),
    ]


def test_supplier_file(spark):
    issues = csv_issues(spark, "F3", F3, MAILED, C3)
    assert [i[1:] for i in issues_of(issues)] == [
        ("type.change", "customer_id", None), ("column.renamed", "email", None), ("type.change", "birth_date", None),
        ("type.change", "amount", None), ("value.type", "customer_id", 4), ("value.format", "birth_date", 2),
        ("value.format", "birth_date", 4), ("value.format", "birth_date", 5), ("value.type", "amount", 3),
        ("value.type", "amount", 4), ("value.type", "amount", 6),
    ]


def test_sample_file_with_inferred_types(spark):
    columns = ["customer_id", "email", "created_at", "marketing_opt_in"]
    df = rows_frame(spark, F4, columns)
    types = {r["column"]: r["type"] for r in schemas.infer_types(df.drop("row")).collect()}
    assert types == {"customer_id": "long", "email": "string", "created_at": "string", "marketing_opt_in": "boolean"}
    assert issues_of(csv_issues(spark, "F4", F4, columns, C1)) == [
        ("FAIL", "column.missing", "signup_ts", None), ("WARN", "column.missing", "country", None),
        ("WARN", "column.extra", "created_at", None), ("WARN", "column.extra", "marketing_opt_in", None),
    ]


def test_equal_schema_passes(spark):
    issues = validate.dataset_issues(spark, "F5", None, C4, received=declared(spark, "F5", F5))
    assert issues.count() == 0
    assigned = spark.createDataFrame([("F5", C4.name)], ASSIGNMENTS)
    (row,) = report.validation_report(assigned, issues).collect()
    assert (row["status"], row["issues"], row["corrections"], row["problems"]) == ("PASS", [], [], [])


@pytest.mark.parametrize("rows, contract, expected", [
    ([("123", "test@gmail.com", "01/01/1990", "25.5"), ("124", "invalid-email", "1991-02-03", "bad")], C3,
     [("value.pattern", "email", 3), ("value.format", "birth_date", 2), ("value.type", "amount", 3)]),
    ([("123", "test@gmail.com", "1990-01-01", "-1")], C2, [("value.min", "amount", 2)]),
])
def test_rows_alone(spark, rows, contract, expected):
    df = rows_frame(spark, rows, ["customer_id", "email", "birth_date", "amount"])
    found = row_issues.quality_report(df, [contract], F.col("row"), F.lit("rows")).orderBy("ord").collect()
    assert [(r["check"], r["column"], r["row"]) for r in found] == expected


def test_golden_cases(spark):
    one = csv_issues(spark, "F2", F2, MAILED, C2)
    two = csv_issues(spark, "F3", F3, MAILED, C3)
    issues = one.unionByName(two).unionByName(
        validate.dataset_issues(spark, "F1", None, C1, received=declared(spark, "F1", F1)))
    assigned = spark.createDataFrame([("F1", C1.name), ("F2", C2.name), ("F3", C3.name)], ASSIGNMENTS)
    cases = spark.createDataFrame([
        ("breaking", "F1", "FAIL", ["type.change", "column.missing", "column.extra"],
         ["CAST_SOURCE_COLUMN", "ADD_SOURCE_COLUMN", "ADD_CONTRACT_COLUMN"]),
        ("drift", "F3", "FAIL", ["column.renamed", "type.change", "value.format", "value.type"],
         ["RENAME_SOURCE_COLUMN", "CAST_SOURCE_COLUMN", "NORMALIZE_DATE_FORMAT", "CAST_OR_CLEAN_VALUE"]),
        ("full", "F2", "FAIL", ["column.renamed", "value.required", "value.format", "value.min"],
         ["RENAME_SOURCE_COLUMN", "FILL_REQUIRED_VALUE", "NORMALIZE_DATE_FORMAT", "ENFORCE_MIN_VALUE"]),
        ("wrong", "F1", "PASS", ["value.max"], ["ENFORCE_MAX_VALUE"]),
    ], "name string, dataset string, expected_status string, expected_checks array<string>, "
       "expected_corrections array<string>")
    results = gate.evaluate_cases(cases, report.validation_report(assigned, issues))
    named = cases.join(assigned, "dataset")
    assert sorted(gate.evaluate_cases(named, report.validation_report(assigned, issues)).collect()) == sorted(results.collect())
    found = {r["name"]: r["failures"] for r in results.collect()}
    assert found == {
        "breaking": [], "drift": [], "full": [],
        "wrong": ["status expected PASS got FAIL", "missing check value.max", "missing correction ENFORCE_MAX_VALUE"],
    }
    assert gate.all_passed(results).first().asDict() == {"passed": False, "case_count": 4}


@pytest.mark.parametrize("source, contract, rows, units", [(4, C1, 0, 16), (4, C2, 7, 44), (4, C3, 5, 36)])
def test_cost_units(spark, source, contract, rows, units):
    received = declared(spark, "x", [(f"c{n}", "string") for n in range(source)])
    counts = spark.createDataFrame([("x", rows)], "dataset string, data_rows long")
    assigned = spark.createDataFrame([("x", contract.name)], ASSIGNMENTS)
    (row,) = gate.budget_check(gate.cost_units(assigned, rules_frame(spark, contract), received, counts)).collect()
    assert row["estimated_units"] == units and row["breach"] is None
