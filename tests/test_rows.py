"""Row checks against a plain reading of the rules, and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import C2, C3, rows_frame
from pactum.operators import cell_checks, remediate, report, row_issues
from pactum.types import Contract, Rule

COLUMNS = ["customer_id", "email", "birth_date", "amount"]


def noisy_rows(n, seed):
    rng = random.Random(seed)
    return [(
        rng.choice(["", "\t", "12", "x1", "1_0", "3.0"]), rng.choice(["a@b.c", "bad", None, " z@y.x "]),
        rng.choice(["1990-01-02", "01/01/1990", "1990-2-30", ""]), rng.choice(["1", "-1", "abc", "nan", "0", "1d"]),
    ) for _ in range(n)]


def cell_verdicts(spark, rows, contract):
    df = rows_frame(spark, rows, COLUMNS)
    return {r["row"]: r for r in row_issues.first_failures(df, contract, ["row"]).collect()}


def capped(verdicts, contract, cap=20):
    """The capped list by the letter: column by column, row by row, stop at the cap."""
    issues = []
    for rule in contract.rules:
        empty = []
        for row in sorted(verdicts):
            if len(issues) >= cap:
                break
            check = verdicts[row][f"check_{rule.column}"]
            if check == "value.required":
                empty.append(row)
            elif check is not None:
                issues.append((check, rule.column, row, None))
        if empty and len(issues) < cap:
            issues.append(("value.required", rule.column, empty[0], f"{len(empty)} empty values"))
    if len(issues) >= cap:
        issues.append(("quality.issue_limit", "*", None, f"{len(issues)} sampled issues"))
    return issues


@pytest.mark.parametrize("n", [3, 9, 14, 40, 200])
def test_cap_by_the_letter(spark, n):
    rows = noisy_rows(n, n)
    expected = capped(cell_verdicts(spark, rows, C2), C2)
    df = rows_frame(spark, rows, COLUMNS)
    found = row_issues.quality_report(df, [C2], F.col("row"), F.lit("d")).orderBy("ord").collect()
    assert [
        (r["check"], r["column"], r["row"],
         r["actual"] if r["check"] in ("value.required", "quality.issue_limit") else None) for r in found
    ] == expected


def test_cap_reached_exactly(spark):
    rows = [("1", "bad", "1990-01-01", "1")] * 20
    df = rows_frame(spark, rows, COLUMNS)
    found = row_issues.quality_report(df, [C2], F.col("row"), F.lit("d")).collect()
    assert len(found) == 21 and {r["check"] for r in found} == {"value.pattern", "quality.issue_limit"}
    assert row_issues.quality_report(df.limit(19), [C2], F.col("row"), F.lit("d")).count() == 19


def test_counts_samples_and_splits_agree(spark):
    df = rows_frame(spark, noisy_rows(300, 5), COLUMNS).cache()
    issues = row_issues.row_issues(df, [C3], F.col("row"), F.lit("d")).cache()
    counts = row_issues.violation_counts(df, [C3], F.lit("d"))
    assert counts.agg(F.sum("violations")).first()[0] == issues.count()
    summary = row_issues.issue_summary(df, [C3], F.col("row"), F.lit("d"))
    assert summary.agg(F.sum("n")).first()[0] == issues.count()
    sample = row_issues.issue_sample(df, [C3], F.col("row"), F.lit("d")).filter("check LIKE 'value.%'")
    cells = sample.filter("check <> 'value.required'").select("row", "column", "check")
    assert cells.join(issues, ["row", "column", "check"], "left_anti").count() == 0
    valid, bad = remediate.quarantine_split(df, C3)
    assert valid.count() + bad.count() == df.count()
    assert bad.select("row").exceptAll(issues.select("row").distinct()).count() == 0
    assert valid.columns == df.columns


def test_typed_columns_give_the_outcome_of_their_text(spark):
    contract = Contract("typed", [
        Rule("i", "long", min_value="2"), Rule("d", "double", max_value="5"), Rule("m", "decimal", min_value="1.5"),
        Rule("b", "boolean"), Rule("dt", "date"), Rule("ts", "timestamp"), Rule("d2", "long"), Rule("i2", "boolean"),
        Rule("dt2", "timestamp"), Rule("ts2", "date"), Rule("m2", "int"), Rule("b2", "int"),
    ])
    typed = spark.sql("""
        SELECT row, CAST(row AS int) AS i, CAST(row * 1.5 AS double) AS d, CAST(row AS decimal(10,2)) AS m,
          row % 2 = 0 AS b, DATE'2024-01-01' AS dt, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts, CAST(row AS double) AS d2,
          CAST(row AS int) AS i2, DATE'2024-01-01' AS dt2, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts2,
          CAST(row AS decimal(10,0)) AS m2, row > 2 AS b2
        FROM (SELECT explode(array(0L, 1L, 2L, 3L, 4L, NULL)) AS row)""")
    texts = typed.select("row", *[F.col(c).cast("string").alias(c) for c in typed.columns[1:]])
    one = {r["row"]: r.asDict() for r in row_issues.first_failures(typed, contract, ["row"]).collect()}
    two = {r["row"]: r.asDict() for r in row_issues.first_failures(texts, contract, ["row"]).collect()}
    for row in two:
        for name, check in two[row].items():
            assert one[row].get(name) == check, (row, name)


def test_nan_with_a_bound_is_a_type_issue(spark):
    contract = Contract("n", [Rule("a", "double", min_value="0"), Rule("b", "double")])
    texts = spark.createDataFrame([(1, "nan", "nan"), (2, "1", "x")], "row int, a string, b string")
    found = row_issues.first_failures(texts, contract, ["row"]).orderBy("row").collect()
    assert [(r["check_a"], r["check_b"]) for r in found] == [("value.type", None), (None, "value.type")]
    typed = spark.createDataFrame([(1, float("nan"), float("nan"))], "row int, a double, b double")
    (row,) = row_issues.first_failures(typed, contract, ["row"]).collect()
    assert row["check_a"] == "value.type" and "check_b" not in row.asDict()


def test_format_alone_judges_dates(spark):
    contract = Contract("f", [Rule("d", "timestamp", format="%d/%m/%Y")])
    df = spark.createDataFrame([(1, "31/12/1999"), (2, "1999-12-31")], "row int, d string")
    found = row_issues.first_failures(df, contract, ["row"]).orderBy("row").collect()
    assert [r["check_d"] for r in found] == [None, "value.format"]


def test_absent_columns_and_names_in_any_case(spark):
    contract = Contract("c", [Rule("Key", "int", True), Rule("gone", "int", True)])
    df = spark.createDataFrame([(1, "x")], "row int, KEY string")
    (issue,) = row_issues.row_issues(df, [contract], F.col("row"), F.lit("d")).collect()
    assert (issue["column"], issue["check"], issue["actual"]) == ("Key", "value.type", "x")


def test_hot_dataset_keeps_every_result(spark):
    """A third of all rows in one dataset: nothing is lost, the sample stays per dataset."""
    df = spark.range(3000).select(
        (F.col("id") + 2).alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("dataset"), F.lit("bad").alias("amount"))
    contract = Contract("h", [Rule("amount", "double")])
    counts = row_issues.violation_counts(df, [contract], F.col("dataset"))
    assert counts.agg(F.sum("violations")).first()[0] == 3000
    sample = row_issues.issue_sample(df, [contract], F.col("row"), F.col("dataset")).filter("dataset = 'hot'")
    assert [r["row"] for r in sample.filter("check = 'value.type'").orderBy("n").collect()] == [
        2 + 3 * n for n in range(20)]


def test_one_scan_per_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_frame(spark, noisy_rows(20, 1), COLUMNS).withColumn("unused", F.lit("x")).write.parquet(path)
    df = spark.read.parquet(path)
    counts = row_issues.violation_counts(df, [C2], F.lit("d"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_sample_is_cut_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_frame(spark, noisy_rows(20, 1), COLUMNS).write.parquet(path)
    sample = row_issues.issue_sample(spark.read.parquet(path), [C2], F.col("row"), F.lit("d"))
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # cell issues; blanks of the required columns
    limit, exchange = plan.index("row_number(), 20, Partial"), plan.index("Exchange hashpartitioning")
    assert exchange < limit  # plans print from the end of the work to its beginning


def test_single_rules_return_none_without_rule(spark):
    df = spark.createDataFrame([("x",)], "a string")
    (cell,) = cell_checks.locate_cells(df, Contract("c", [Rule("a", "string")]))
    assert cell_checks.breaks_allowed(cell) is None and cell_checks.cell_check(cell) is None


def test_apply_plan_leaves_valid_rows_under_the_contract(spark):
    rows = [(a, b or "x@y.z", c, d) for a, b, c, d in noisy_rows(60, 9)]
    df = rows_frame(spark, rows, ["customer_id", "mail", "birth_date", "amount"])
    from pactum.plans import validate
    from pactum.sources import schemas

    received = schemas.infer_types(df.drop("row"), dataset=F.lit("d"))
    valid, rejected = validate.remediate_dataset(
        spark, "d", df, C2, F.col("row"), received, {"birth_date": ["%d/%m/%Y"]}, warn_extra_columns=False)
    assert valid.count() + rejected.count() == 60
    assert dict(valid.dtypes) == {
        "row": "bigint", "customer_id": "bigint", "email": "string", "birth_date": "date", "amount": "double"}
    assert valid.filter("amount < 0").count() == 0
    assert report.status_of(F.lit(0)) is not None


def test_many_contracts_are_few_tests_in_one_scan(spark):
    """Contracts that share rules share tests; one with two rules on a column has both; rows of no contract pass."""
    contracts = [
        Contract(f"c{k}", [Rule("a", "int", k % 2 == 0, max_value=str(k % 3)), Rule("A", "string", pattern="[0-9]+"), Rule("gone", "int")])
        for k in range(60)
    ]
    df = spark.createDataFrame([(n, f"c{n % 61}", v) for n, v in enumerate(["1", "x", None, " 2 ", "", "7"] * 61)] + [(999, None, "x")], "row int, contract string, a string")
    compiled = row_issues.Compiled(df, contracts, "contract")
    assert [len(slot.tests) for slot in compiled.slots] == [6, 1]
    got = {(r.row, r.pos, r.check, r.expected) for r in row_issues.row_issues(df, contracts, F.col("row"), F.lit("d"), "contract").collect()}
    want = set()
    for row, name, v in [tuple(r) for r in df.collect()]:
        k = int(name[1:]) if name else 60
        v = (v or "").strip()
        if k == 60:
            continue
        if not v:
            want |= {(row, 0, "value.required", "non-empty value")} if k % 2 == 0 else set()
        elif not v.isdigit():
            want |= {(row, 0, "value.type", "int"), (row, 1, "value.pattern", "[0-9]+")}
        elif int(v) > k % 3:
            want.add((row, 0, "value.max", f"<= {k % 3}"))
    assert got == want
    counts = row_issues.violation_counts(df, contracts, F.lit("d"), "contract")
    assert counts.agg(F.sum("violations")).first()[0] == len(want)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + counts._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2
    with pytest.raises(ValueError, match="several contracts"):
        row_issues.row_issues(df, contracts, F.col("row"), F.lit("d"))
