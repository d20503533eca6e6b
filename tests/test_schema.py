"""Schema comparison: names, types, renames."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.functions import names
from pactum.operators import schema_diff as sd
from pactum.types import ASSIGNMENTS, COLUMNS_META, Contract, Rule, rules_frame


def diff(spark, contract, columns, **options):
    received = spark.createDataFrame([("d", n, c, t, False) for n, (c, t) in enumerate(columns)], COLUMNS_META)
    assigned = spark.createDataFrame([("d", contract.name)], ASSIGNMENTS)
    rows = sd.schema_diff(assigned, rules_frame(spark, contract), received, **options).orderBy("ord").collect()
    return [(r["check"], r["severity"], r["column"], r["expected"], r["actual"]) for r in rows]


def test_a_dataset_under_two_contracts(spark):
    contracts = [Contract("c1", [Rule("a", "int")]), Contract("c2", [Rule("b", "int")]), Contract("c3", [])]
    received = spark.createDataFrame([("d", 0, "a", "int", False), ("e", 0, "a", "int", False)], COLUMNS_META)
    assigned = spark.createDataFrame([("d", "c1"), ("d", "c2"), ("d", "c3")], ASSIGNMENTS)
    found = sd.schema_diff(assigned, rules_frame(spark, *contracts), received)
    assert {(r["dataset"], r["contract"], r["ord"], r["check"], r["column"]) for r in found.collect()} == {
        ("d", "c2", 1, "column.missing", "b"), ("d", "c2", 2, "column.extra", "a"), ("d", "c3", 1, "column.extra", "a")}


def test_type_names(spark):
    pairs = [("INTEGER", "int"), (" varchar(10) ", "string"), ("numeric (5, 2)", "decimal"), ("array<int>", "array<int>"),
             ("timestamp_ntz", "timestamp"), ("long", "long"), ("smallint", "smallint"), ("", ""), (None, "")]
    df = spark.createDataFrame(pairs, "t string, n string")
    assert df.filter(names.type_form(F.col("t")) != F.col("n")).collect() == []


def test_promotion_goes_one_way(spark):
    contract = Contract("c", [Rule("a", "int"), Rule("b", "long"), Rule("c", "float"), Rule("d", "double")])
    columns = [("a", "bigint"), ("b", "int"), ("c", "double"), ("d", "float")]
    assert [(x[0], x[1], x[2]) for x in diff(spark, contract, columns)] == [
        ("type.promotion", "WARN", "a"), ("type.change", "FAIL", "b"), ("type.promotion", "WARN", "c"),
        ("type.change", "FAIL", "d")]
    strict = diff(spark, contract, columns, allow_safe_promotion=False)
    assert {x[0] for x in strict} == {"type.change"} and len(strict) == 4


def test_last_duplicate_is_matched_and_first_candidate_is_the_rename(spark):
    contract = Contract("c", [Rule("amount", "double"), Rule("email", "string"), Rule("mail_address", "string")])
    columns = [("Amount", "string"), ("AMOUNT", "double"), ("zmail", "string"), ("mail", "string")]
    # one received column may serve several missing ones
    assert diff(spark, contract, columns) == [
        ("column.renamed", "FAIL", "email", "email", "zmail"),
        ("column.renamed", "FAIL", "mail_address", "mail_address", "mail"),
    ]


def test_extra_columns_can_be_ignored(spark):
    contract = Contract("c", [Rule("a", "int")])
    columns = [("a", "int"), ("zzz", "string")]
    assert diff(spark, contract, columns) == [("column.extra", "WARN", "zzz", None, "string")]
    assert diff(spark, contract, columns, warn_extra_columns=False) == []


def similar(left, right):
    """Plain reading of the rule."""
    l, r = ("".join(c for c in x.lower() if c.isalnum()) for x in (left, right))
    if not l or not r:
        return False
    if l in r or r in l:
        return True
    row = list(range(len(r) + 1))
    for i, a in enumerate(l, 1):
        row = _next(row, i, a, r)
    return row[-1] <= 2 and min(len(l), len(r)) >= 4


def _next(row, i, a, r):
    out = [i]
    for j, b in enumerate(r, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
    return out


name = st.text(alphabet="abcAB1_ é-", min_size=1, max_size=14)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(name, min_size=1, max_size=12, unique_by=str.lower),
       st.lists(name, min_size=1, max_size=12, unique_by=str.lower))
def test_blocking_finds_every_similar_pair(spark, wanted, got):
    lowered = {w.lower() for w in wanted}
    got = [g for g in got if g.lower() not in lowered] or ["~"]
    align = spark.createDataFrame(
        [("d", w.lower(), n, w, None, None) for n, w in enumerate(wanted)]
        + [("d", g.lower(), None, None, n, g) for n, g in enumerate(got)],
        "dataset string, key string, exp_pos int, exp_column string, src_pos int, src_column string")
    found = {(r["exp_column"], r["src_column"]) for r in sd.rename_similarity(align).collect()}
    assert found == {(w, g) for w in wanted for g in got if similar(w, g)}


def test_blocking_on_edited_long_names(spark):
    rng = random.Random(3)
    rows, expected = [], set()
    for n in range(150):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 40)))
        edited = list(base)
        for _ in range(2):
            at = rng.randrange(len(edited))
            kind = rng.choice("dis")
            if kind == "d" and len(edited) > 4:
                del edited[at]
            elif kind == "i":
                edited.insert(at, rng.choice("xyz"))
            else:
                edited[at] = rng.choice("xyz")
        edited = "".join(edited)
        if edited == base:
            continue
        rows += [(f"d{n}", base, 0, base, None, None), (f"d{n}", edited, None, None, 0, edited)]
        if similar(base, edited):
            expected.add(f"d{n}")
    align = spark.createDataFrame(
        rows, "dataset string, key string, exp_pos int, exp_column string, src_pos int, src_column string")
    assert {r["dataset"] for r in sd.renamed_columns(align).collect()} == expected


def test_few_keys_a_name_and_one_alignment(spark):
    from pactum.functions import names

    forms = ["customerid", "email", "birthdate", "amount", "optin", "visits", "country", "custid", "mail", "contact", "emial", "amounteur"]
    sizes = F.array(F.lit(8), F.lit(4))  # of the anchors on the other side
    keys = spark.createDataFrame([(f,) for f in forms], "form string").select(
        F.size(names.received_keys("form", sizes)).alias("n")).agg(F.avg("n")).first()[0]
    assert keys <= 12
    rules = rules_frame(spark, Contract("c", [Rule("a", "long", True)]))
    received = spark.createDataFrame([("d", 0, "b", "string", False)], COLUMNS_META)
    plan = sd.schema_findings(spark.createDataFrame([("d", "c")], "dataset string, contract string"), rules, received)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join FullOuter") == 1 and "Cross" not in text


def test_naming_and_versions(spark):
    received = spark.createDataFrame([("d", n, c, "string", False) for n, c in enumerate(
        ["ok_name", "BadName", "9x", "a__b", "x1"])], COLUMNS_META)
    assert [r["column"] for r in sd.naming_violations(received).orderBy("pos").collect()] == ["BadName", "9x", "a__b"]
    old = rules_frame(spark, Contract("c", [Rule("a", "long", True), Rule("b", "date", format="%Y"), Rule("c", "int")]))
    new = rules_frame(spark, Contract("c", [Rule("A", "string", True), Rule("b", "date", format="%d"), Rule("d", "int", True)]))
    found = {(r["column"], r["change"], r["grade"]) for r in sd.breaking_changes(old, new).collect()}
    assert found == {
        ("A", "type changed", "potentially breaking"), ("b", "format changed", "potentially breaking"),
        ("c", "optional column removed", "compatible"), ("d", "required column added", "breaking")}


def test_a_fleet_read_from_files_is_never_broadcast(spark, tmp_path):
    """Files of a large fleet may look small to the optimizer; only the rules may go whole to every task."""
    contract = Contract("c", [Rule("id", "bigint"), Rule("mail", "string")])
    fleet = spark.range(2000).selectExpr("concat('d', id) AS dataset", "'c' AS contract")
    fleet.write.parquet(str(tmp_path / "fleet"))
    fleet.selectExpr("dataset", "0 AS pos", "'mial' AS column", "'string' AS type", "false AS required").write.parquet(str(tmp_path / "columns"))
    align = sd.aligned(spark.read.parquet(str(tmp_path / "fleet")), rules_frame(spark, contract), spark.read.parquet(str(tmp_path / "columns")))
    for frame in (align, sd.renamed_columns(align), sd.rename_similarity(align)):
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        for n, line in enumerate(plan):
            if "BroadcastExchange" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = [x for x in plan[n + 1:]][: next((k for k, x in enumerate(plan[n + 1:]) if len(x) - len(x.lstrip(" :+-")) <= depth), None)]
                assert not any("FileScan" in x for x in below), "\n".join(plan)
    assert sd.renamed_columns(align).count() == 2000


def test_schema_findings_of_a_fleet_read_from_files_never_broadcast_it(spark, tmp_path):
    """The offers of undeclared names meet the fleet by a shuffle too; only rules and offers go to every task."""
    contract = Contract("c", [Rule("id", "bigint"), Rule("mail", "string")])
    fleet = spark.range(2000).selectExpr("concat('d', id) AS dataset", "'c' AS contract")
    fleet.write.parquet(str(tmp_path / "fleet"))
    fleet.selectExpr("dataset", "0 AS pos", "'mial' AS column", "'string' AS type", "false AS required").write.parquet(str(tmp_path / "columns"))
    inputs = (spark.read.parquet(str(tmp_path / "fleet")), rules_frame(spark, contract), spark.read.parquet(str(tmp_path / "columns")))
    frames = (sd.schema_diff(*inputs), sd.schema_findings(*inputs, allow_safe_promotion=False, warn_extra_columns=False),
              sd.missing_columns(*inputs), sd.extra_columns(*inputs))
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        for n, line in enumerate(plan):
            if "BroadcastExchange" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = plan[n + 1:][: next((k for k, x in enumerate(plan[n + 1:]) if len(x) - len(x.lstrip(" :+-")) <= depth), None)]
                assert not any("FileScan" in x for x in below), "\n".join(plan)
    assert {(r["check"], r["column"], r["actual"]) for r in frames[0].collect()} == {
        ("column.renamed", "mail", "mial"), ("column.missing", "id", None)}
    assert frames[0].count() == 4000 and frames[2].count() == 2000 and frames[3].count() == 0


def test_statuses_of_a_fleet_read_from_files_never_broadcast_it(spark, tmp_path):
    """Gates, rollups and summaries judge schemas by the same findings: the fleet goes by shuffles there too."""
    from pactum.plans import validate

    contract = Contract("c", [Rule("id", "bigint"), Rule("mail", "string")])
    fleet = spark.range(2000).selectExpr("concat('d', id) AS dataset", "'c' AS contract")
    fleet.write.parquet(str(tmp_path / "fleet"))
    fleet.selectExpr("dataset", "0 AS pos", "'mial' AS column", "'string' AS type", "false AS required").write.parquet(str(tmp_path / "columns"))
    frame = validate.statuses(spark.read.parquet(str(tmp_path / "fleet")), rules_frame(spark, contract), spark.read.parquet(str(tmp_path / "columns")))
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    for n, line in enumerate(plan):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = plan[n + 1:][: next((k for k, x in enumerate(plan[n + 1:]) if len(x) - len(x.lstrip(" :+-")) <= depth), None)]
            assert not any("FileScan" in x for x in below), "\n".join(plan)
    assert {(r["status"], r["fail_count"], r["warn_count"]) for r in frame.collect()} == {("FAIL", 1, 1)}
