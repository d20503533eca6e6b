"""Reports, sinks, gate, retrieval and the registered queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracles import compare, duck
from fixtures import C2, F2, rows_frame
from pactum.operators import gate, profile, remediate, report, retrieve
from pactum.plans import validate
from pactum.sinks import reports as sinks
from pactum.sources import schemas
from pactum.types import Contract, Rule

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reports(spark):
    df = rows_frame(spark, F2, ["customer_id", "mail", "birth_date", "amount"])
    received = schemas.infer_types(df.drop("row"), dataset=F.lit("F2"))
    return validate.validate_dataset(spark, "F2", df, C2, F.col("row"), received, cap=20).cache()


def test_report_row(reports):
    (row,) = reports.collect()
    assert (row["status"], row["fail_count"], row["warn_count"]) == ("FAIL", 14, 0)
    assert len(row["problems"]) == 9 and len(row["corrections"]) == 9
    assert "4 cells empty" in row["problems"][5] and " 3 cells" in row["problems"][6]
    assert len(row["causes"]) == 7 and row["impacts"][-1].startswith("address protection")
    assert row["supplier_message"].count("\n3) ") == 2 and "\n4) " not in row["supplier_message"]


def test_json_report_leaves_out_what_is_absent(reports, tmp_path):
    (row,) = sinks.report_json(reports).collect()
    document = json.loads(row["json"])
    assert document["counts"] == {"FAIL": 14, "WARN": 0, "INFO": 0} and document["source"] == "F2"
    assert "row" not in document["issues"][0] and document["issues"][4]["row"] == 5
    sinks.write_documents(sinks.report_json(reports), str(tmp_path / "r"))


def test_json_report_keeps_lists(spark):
    contract = Contract("c", [Rule("a", "string", allowed_values=["x", "y"])])
    df = spark.createDataFrame([(2, "z")], "row int, a string")
    (row,) = sinks.report_json(validate.validate_dataset(
        spark, "d", df, contract, F.col("row"), warn_extra_columns=False)).collect()
    assert json.loads(row["json"])["issues"][0]["expected"] == ["x", "y"]


def test_markdown_report(reports):
    text = sinks.report_markdown(reports).first()["markdown"]
    assert text.startswith("# `F2`: refused\n\nChecked against `customers_contract`. Status FAIL (blocking: 14, to note: 0).")
    assert "\n| 5 | FAIL | value.type | customer_id | value unreadable in the agreed type | long | customer_id | 5 | " in text


def test_exact_report_counts_every_cell(spark):
    df = rows_frame(spark, [("1", "a@b.c", "1990-01-01", "bad")] * 90, ["customer_id", "email", "birth_date", "amount"])
    row = validate.validate_dataset(spark, "d", df, C2, F.col("row"), cap=None, warn_extra_columns=False).first()
    assert any(" 90 cells" in p for p in row["problems"])


def test_alerts_and_history_append(spark, reports, tmp_path):
    alerts = sinks.alerts(reports, "ops")
    for _ in range(2):
        sinks.append_alerts(alerts, str(tmp_path / "alerts"))
    assert spark.read.json(str(tmp_path / "alerts")).count() == 2
    units = spark.createDataFrame([("F2", C2.name, 44), ("F2", "other", 1)], "dataset string, contract string, estimated_units long")
    seen = sinks.append_runs(sinks.run_history(reports, units, "t"), str(tmp_path / "runs"))
    assert seen.get == {"reports": 1, "failed": 1, "issues": 14}


def test_gate(spark):
    statuses = spark.createDataFrame([("a", "PASS"), ("b", "WARN"), ("c", "FAIL")], "dataset string, status string")
    assert [r["decision"] for r in gate.gate(statuses).orderBy("dataset").collect()] == ["allow", "allow", "block"]
    with pytest.raises(gate.ContractViolation, match="b, c"):
        gate.enforce_gate(statuses, fail_on_warning=True)
    gate.enforce_gate(statuses.filter("status <> 'FAIL'"))


def test_budget_order(spark):
    costs = spark.createDataFrame([("a", 9, 9, 9), ("b", 1, 9, 9), ("c", 1, 1, 9), ("d", 1, 1, 1)],
                                  "dataset string, source_columns long, contract_columns long, data_rows long")
    found = {r["dataset"]: r["breach"] for r in gate.budget_check(costs, 5, 5, 5).collect()}
    assert found == {"a": "source_columns", "b": "contract_columns", "c": "data_rows", "d": None}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.integers(-2, 3, size=(400, 8)).astype(float)  # many ties
    df = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "id long, v array<float>").repartition(7)
    queries = [(n, points[n].tolist()) for n in (0, 5)]
    found = retrieve.knn_topk(df, "id", "v", queries, k=4).orderBy("query_id", "rank").collect()
    expected = [
        (q, rank, n, d) for q, p in queries
        for rank, (d, n) in enumerate(sorted((float(((x - np.array(p)) ** 2).sum()), n) for n, x in enumerate(points))[:4], 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in found] == expected
    with pytest.raises(ValueError):
        retrieve.collect_queries(spark.range(5).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vector")), 4)


def test_personal_data(spark):
    df = spark.createDataFrame([(1, "mail bob.x@mail.example.org, call (555) 123-4567 or 123-45-6789"), (2, "none")],
                               "id int, t string")
    assert [tuple(r) for r in profile.pii_counts(df, "id", "t").collect()] == [(1, 1, 1, 1)]
    assert remediate.mask_pii(df, ["t"]).first()["t"] == "mail <email>, call <phone> or <ssn>"
    contract = Contract("c", [Rule("T", pii=True)])
    assert remediate.drop_pii(df, contract).columns == ["id"]


def test_profile_estimate_matches_exact_on_small_data(spark):
    df = spark.createDataFrame([("a", " "), ("a", None), ("b", "x")], "p string, q string")
    exact = profile.profile_columns(df, ["p", "q"]).orderBy("column").collect()
    assert exact == profile.profile_columns(df, ["p", "q"], exact=False).orderBy("column").collect()
    assert tuple(exact[1]) == ("q", 3, 2, 1, "x", "x")


def test_write_split_and_drop(spark, tmp_path):
    df = rows_frame(spark, F2, ["customer_id", "mail", "birth_date", "amount"])
    remediate.write_split(df, C2, str(tmp_path / "s"))
    counts = {r["verdict"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("verdict").count().collect()}
    assert counts == {"quarantined": 7}
    assert remediate.drop_extra(df, C2).columns == ["customer_id", "birth_date", "amount"]


@pytest.mark.parametrize("name", ["customer_contract", "row_issues", "schema_diff", "validation_report", "stream_gate"])
def test_registered_queries_match_their_sql(spark, name):
    import __spark_entry__ as entry

    _, n, verdict = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert (verdict, n > 0) == ("ok", True)


def test_every_column_is_reported_after_many_issues(spark):
    """A column that breaks after twenty issues of another still has its correction, fix and impact."""
    contract = Contract("c", rules=[Rule("v", allowed_values=["a", "b"]), Rule("w", "double")])
    df = spark.createDataFrame([(k, "z", "none") for k in range(30)], "row long, v string, w string")
    row = validate.validate_dataset(spark, "d", df, contract, F.col("row"), warn_extra_columns=False).first()
    found = [i for i in row.issues if i["check"].startswith("value.")]
    assert [(i["column"], i["check"]) for i in found] == [("v", "value.allowed"), ("w", "value.type")]
    assert row.fail_count >= 60 and {c["target"] for c in row.corrections} >= {"v", "w"} and len(row.fixes) >= 1


def test_long_addresses_are_masked_whole(spark):
    text = "to " + "x" * 80 + "@" + ".".join(["label" * 15] * 15) + ".com now"
    df = spark.createDataFrame([(text,)], "t string")
    from pactum.functions import pii

    assert df.select(pii.count_emails(F.col("t"))).first()[0] == 1
    masked = df.select(F.regexp_replace("t", pii.EMAIL, "<email>")).first()[0]
    assert masked == "to <email> now"


def test_repeated_values_fail_a_unique_column(spark):
    contract = Contract("c", [Rule("id", "string", unique=True), Rule("v", "string")])
    df = spark.createDataFrame([(2, "a", "x"), (3, " a ", "x"), (4, None, "x"), (5, "", "x"), (6, "b", "x"), (7, "c", "x"), (8, "c", "x")], "row long, id string, v string")
    row = validate.validate_dataset(spark, "d", df, contract, F.col("row"), warn_extra_columns=False).first()
    assert (row.status, row.fail_count) == ("FAIL", 4) and row.problems == ["`id`: 4 cells share a value"]
    assert [(i["check"], i["row"], i["expected"]) for i in row.issues] == [("value.unique", 2, "unique values")]
    assert [tuple(c)[:2] for c in row.corrections] == [("REMOVE_DUPLICATES", "id")]
    # no line in the plan: the suggestion stands in for it
    assert "1) send each `id` once" in row.supplier_message and row.proposed_correction == "send each `id` once."
    once = validate.validate_dataset(spark, "d", df.filter("row > 4 AND row < 8"), contract, F.col("row"), warn_extra_columns=False).first()
    assert once.status == "PASS"


def test_two_contracts_are_kept_apart(spark):
    from pactum.operators import row_issues
    from pactum.types import ASSIGNMENTS, COLUMNS_META, rules_frame as rules

    contracts = [Contract("good", [Rule("a", "string")]), Contract("bad", [Rule("a", "int"), Rule("b", "int", True)])]
    assigned = spark.createDataFrame([("d", "good"), ("d", "bad"), ("e", "good")], ASSIGNMENTS)
    received = spark.createDataFrame([("d", 0, "a", "string", False), ("e", 0, "a", "string", False)], COLUMNS_META)
    rows = spark.createDataFrame([(2, "d", "x"), (3, "d", "1")], "row long, dataset string, a string").join(assigned, "dataset")
    issues = validate.merged_issues(assigned, rules(spark, *contracts), received, row_issues.cell_totals(rows, contracts, F.col("row"), F.col("dataset"), "contract"))
    found = {(r.dataset, r.contract): (r.status, [i["check"] for i in r.issues]) for r in report.validation_report(assigned, issues).collect()}
    assert found == {
        ("d", "good"): ("PASS", []), ("e", "good"): ("PASS", []),
        ("d", "bad"): ("FAIL", ["type.change", "column.missing", "value.type"])}
    states = validate.statuses(assigned, rules(spark, *contracts), received, row_issues.bad_cell_counts(rows, contracts, F.col("dataset"), "contract"))
    assert {(r.dataset, r.contract): r.status for r in states.collect()} == {k: v[0] for k, v in found.items()}


def test_profiles_of_parts_add_up(spark):
    rows = [(n % 4, str(n * 7 % 1000) if n % 10 else " ", None) for n in range(20_000)]
    df = spark.createDataFrame(rows, "part int, v string, w string")
    parts = profile.profile_sketches(df, ["v", "w"], ["part"])
    assert parts.count() == 8
    merged = {r["column"]: r for r in profile.read_profiles(profile.merge_profiles(parts)).collect()}
    whole = {r["column"]: r for r in profile.read_profiles(profile.profile_sketches(df, ["v", "w"])).collect()}
    v = merged["v"]
    assert (v.row_count, v.blank_count, v.min_value, v.max_value) == (20_000, 2_000, "1", "999")
    assert all(abs(x["v"].distinct_count / 900 - 1) < 0.05 for x in (merged, whole))
    values = sorted(int(r[1]) for r in rows if r[1] != " ")
    for q, got in ((0.5, v.q50), (0.95, v.q95)):
        assert values[int((q - 0.03) * len(values))] <= got <= values[min(len(values) - 1, int((q + 0.03) * len(values)))]
    assert (merged["w"].distinct_count, merged["w"].blank_count, merged["w"].q50) == (0, 20_000, None)
    # values don't meet: one exchange, of a row a group and task
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1 and "value" not in plan.split("Exchange")[1].split("\n")[0]


def test_budget_is_known_before_a_scan(spark, tmp_path):
    for name, n in (("small", 10), ("large", 100)):
        spark.range(n).write.parquet(str(tmp_path / name))
    contract = Contract("c", [Rule("id", "long")])
    members = [(name, spark.read.parquet(str(tmp_path / name)), contract, F.col("id")) for name in ("small", "large")]
    kept, costs = validate.within_budget(spark, members, max_data_rows=50)
    assert [m[0] for m in kept] == ["small"]
    assert {r.dataset: (r.data_rows, r.breach) for r in costs.collect()} == {"small": (10, None), "large": (100, "data_rows")}
    plan = gate.count_rows({m[0]: m[1] for m in members})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<>") == 2


def test_nearest_of_many_queries_against_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-2, 3, size=(300, 6)), rng.normal(0, 1, (900, 6)) + rng.integers(0, 4, (900, 1)) * 8, np.zeros((50, 6))])
    rows = [(n, p.tolist()) for n, p in enumerate(points.astype(float))] + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = [(n, points[n].tolist()) for n in range(0, len(points), 3)] + [(9000, (points[0] + 100).tolist()), (9001, None), (9002, [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.distance) for r in retrieve.knn_join(df, "id", "v", queries, 4).collect()}
    want = set()
    for q, p in asked:
        if p is None or len(p) != 6:
            continue
        distance = ((points - np.array(p)) ** 2).sum(axis=1)
        want |= {(q, rank, int(n), float(distance[n])) for rank, n in enumerate(np.lexsort((np.arange(len(points)), distance))[:4], 1)}
    assert got == want
    assert retrieve.knn_join(df, "id", "v", queries.limit(0), 4).count() == 0 and retrieve.knn_join(df.limit(0), "id", "v", queries, 4).count() == 0
    # more than there are
    assert retrieve.knn_join(df.filter("id < 3"), "id", "v", queries.limit(2), 7).count() == 6
    assert retrieve.knn_topk(df, "id", "v", [], 3).count() == 0
