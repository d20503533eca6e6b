"""Files, contracts, declared schemas, listing, row numbers, arriving files."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import C2, F2
from pactum.sources import contracts, files, schemas
from pactum.streaming import arrivals
from pactum.types import collect_contracts

YAML = """
dataset: customers   # a comment
version: 1.0.0
criticality: high
columns:
  - name: customer_id
    type: long
    required: true
    unique: true
  - name: email
    pii: true
    checks:
      - type: regex
        pattern: "^[^@]+@[^@]+\\\\.[^@]+$"
  - name: status
    allowed_values:
      - ACTIVE
      - INACTIVE
  - name: kind
    allowed_values: [a, "b c"]
    required: ~
  - name: amount
    type: double
    min: 0
    maxValue: 1e5
"""


def test_csv_reads_text_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,"say ""hi"", ok",x\n\n2,,\n3\n4,a,b,surplus\n')
    df = files.read_data(spark, str(tmp_path / "a.csv"))
    rows = [tuple(r) for r in df.orderBy("k").collect()]
    assert rows == [("1", 'say "hi", ok', "x"), ("2", None, None), ("3", None, None), ("4", "a", "b")]
    with pytest.raises(ValueError):
        files.read_data(spark, "x.json")


def test_csv_row_numbers_over_many_splits(spark, tmp_path):
    for name, start in [("a", 0), ("b", 5000)]:
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{start + n}\n" for n in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scan = files.scan_csv(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 4
        within = files.with_row_csv(scan).select(F.col("k").cast("int"), "row").collect()
        across = files.with_row_csv(scan, across_files=True).select(F.col("k").cast("int"), "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(within) == len(across) == 10000
    assert all(r["row"] == r["k"] % 5000 + 2 for r in within)
    assert all(r["row"] == r["k"] + 2 for r in across)


def test_csv_row_numbers_over_folders(spark, tmp_path):
    n = 0
    for name in ["a/1", "a/2", "a-b/1", "b/c/1", "b/c/2", "b/1"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{name}-{k}\n" for k in range(40)))
    scan = spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path))
    rows = {r.k: r.row for r in files.with_row_csv(scan, across_files=True).select("k", "row").collect()}
    folders = sorted(["a/", "a-b/", "b/c/", "b/"])
    order = [f + str(x) for f in folders for x in (1, 2) if (tmp_path / f"{f}{x}.csv").exists()]
    assert rows == {f"{name}-{k}": 40 * order.index(name) + k + 2 for name in order for k in range(40)}


def test_parquet_row_numbers(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = files.with_row_parquet(files.scan_parquet(spark, str(tmp_path / "p"))).collect()
    assert all(r["row"] == r["id"] + 2 for r in rows)


def test_inference(spark):
    rows = [("1", "1.5", "true", " ", None, "1", "2024-01-01", "nan"), ("", "2", "FALSE", "1", "", "x", "2024-02-01", "1")]
    df = spark.createDataFrame(rows, ", ".join(f"c{n} string" for n in range(8)))
    found = [r["type"] for r in schemas.infer_types(df).orderBy("pos").collect()]
    assert found == ["long", "double", "boolean", "string", "string", "string", "string", "double"]
    temporal = [r["type"] for r in schemas.infer_types(df, infer_temporal=True).orderBy("pos").collect()]
    assert temporal[6] == "date" and temporal[:6] == found[:6]


def test_contract_files(spark, tmp_path):
    (tmp_path / "one.yaml").write_text(YAML)
    (tmp_path / "two.json").write_text(json.dumps({"columns": [
        {"name": "a", "required": "required", "allowedValues": "only"}, "skipped",
        {"name": "b", "type": None, "min_value": 1.5, "required": 1, "max": "9"}]}))
    rules = contracts.load_contracts(spark, str(tmp_path))
    by_name = {c.name: c for c in collect_contracts(rules)}
    assert sorted(by_name) == ["customers", "unnamed-contract"]
    one = {r.column: r for r in by_name["customers"].rules}
    assert [r.column for r in by_name["customers"].rules] == ["customer_id", "email", "status", "kind", "amount"]
    assert one["customer_id"].required and one["customer_id"].unique and one["email"].pii
    assert one["email"].pattern == r"^[^@]+@[^@]+\.[^@]+$" and one["email"].type == "string"
    assert one["status"].allowed_values == ["ACTIVE", "INACTIVE"] and one["kind"].allowed_values == ["a", "b c"]
    assert (one["amount"].min_value, one["amount"].max_value, one["kind"].required) == ("0", "1e5", False)
    assert by_name["customers"].version == "1.0.0"
    two = by_name["unnamed-contract"]
    assert (two.version, two.owner) == ("0.1.0", "unknown")
    assert [(r.column, r.type, r.required, r.min_value, r.max_value, r.allowed_values) for r in two.rules] == [
        ("a", "string", True, "", "", ["only"]), ("b", "string", True, "1.5", "9", [])]


def test_flags_and_bounds_by_kind_and_key(spark):
    documents = spark.createDataFrame([("s", json.dumps({"columns": [
        {"name": "a", "required": 2, "min": None, "min_value": 3, "unique": "2", "pii": [0]},
        {"name": "b", "required": 0, "min_value": None, "minValue": 4, "max": 1, "maxValue": 9, "unique": 1.5, "pii": {}},
        {"name": "c", "required": " YES ", "unique": None, "pii": True}]}))], "source string, json string")
    rules = {r["column"]: r for r in contracts.contract_rules(documents).collect()}
    assert [(r["required"], r["unique"], r["pii"]) for r in (rules["a"], rules["b"], rules["c"])] == [
        (True, False, True), (False, True, False), (True, False, True)]
    assert [(rules[c]["min_value"], rules[c]["max_value"]) for c in "abc"] == [("", ""), ("", "1"), ("", "")]


def test_broken_schemas(spark):
    documents = spark.createDataFrame([
        ("ok", '{"name": "n", "columns": [{"name": "a"}]}'), ("text", "{oops"), ("none", None), ("object", '{"a": 1}'), ("map", '{"columns": {}}'),
        ("nameless", '[{"type": "int"}]'), ("empty", "[]")], "source string, text string")
    errors = {r["source"]: r["error"] for r in schemas.schema_errors(documents, "source", "text").collect()}
    assert sorted(errors) == ["map", "nameless", "none", "object", "text"]
    assert [(r["dataset"], r["column"]) for r in schemas.schema_from_json(documents, "source", "text", strict=False).collect()] == [("n", "a")]
    with pytest.raises(Exception, match="JSON document|columns|column name"):
        schemas.schema_from_json(documents, "source", "text").collect()


def test_broken_contracts(spark):
    documents = spark.createDataFrame([
        ("good", '{"name": "g", "columns": [{"name": "a"}]}'), ("map", '{"name": "m", "columns": {"a": 1}}'),
        ("nameless", '{"name": "n", "columns": [{"type": "int"}]}'), ("none", '{"name": "e"}'),
    ], "source string, json string")
    errors = {r["source"]: r["error"] for r in contracts.contract_errors(documents).collect()}
    assert errors == {"map": "columns must be a list", "nameless": "column name is missing"}
    rules = contracts.contract_rules(documents, strict=False).collect()
    assert [(r["contract"], r["column"]) for r in rules] == [("g", "a")]
    with pytest.raises(Exception, match="columns must be a list|column name is missing"):
        contracts.contract_rules(documents).collect()


def test_several_regex_checks_must_all_hold(spark):
    from pactum.operators import row_issues

    documents = spark.createDataFrame([("s", json.dumps({"name": "c", "columns": [
        {"name": "v", "pattern": "a.*", "checks": [{"type": "regex", "pattern": ".*z"}]}]}))], "source string, json string")
    (contract,) = collect_contracts(contracts.contract_rules(documents))
    df = spark.createDataFrame([(1, "abz"), (2, "ab"), (3, "bz")], "row int, v string")
    found = row_issues.row_issues(df, [contract], F.col("row"), F.lit("d")).collect()
    assert sorted(r["row"] for r in found) == [2, 3]


def test_contract_size_is_checked(spark):
    documents = spark.createDataFrame([("s", json.dumps({"columns": [{"name": f"c{n}"} for n in range(30)]}))],
                                      "source string, json string")
    with pytest.raises(ValueError):
        collect_contracts(contracts.contract_rules(documents), limit=10)


def test_listing_and_admission(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, size in [("in/a.csv", 5), ("in/deep/a2.PARQUET", 9), ("in/a.txt", 3), ("in/a_empty.csv", 0), ("a_out.csv", 4),
                       ("in/a_big.json", 50), ("in/b.csv", 1)]:
        (tmp_path / name).write_text("x" * size)
    listed = files.list_objects(spark, str(tmp_path), "a")
    judged = files.admit_files(listed, max_bytes=20, roots=[str(tmp_path / "in")])
    found = {r["path"].rsplit("/", 1)[1]: (r["size"], r["reason"]) for r in judged.collect()}
    assert found == {
        "a.csv": (5, None), "a2.PARQUET": (9, None), "a.txt": (3, "bad_suffix"), "a_empty.csv": (0, "empty"),
        "a_out.csv": (4, "outside_root"), "a_big.json": (50, "too_large")}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_documents(spark, tmp_path):
    from pactum.operators import retrieve

    (tmp_path / "b.md").write_text("x" * 2500)
    (tmp_path / "a.md").write_text("line one\nline two")
    (tmp_path / "c.txt").write_text("no")
    chunks = retrieve.chunk_documents(files.scan_documents(spark, str(tmp_path)), "source", "text")
    found = [(r["chunk_id"], len(r["text"])) for r in chunks.orderBy("chunk_id").collect()]
    assert found == [("a.md::0", 17), ("b.md::0", 1000), ("b.md::1", 1000), ("b.md::2", 500)]
    assert retrieve.chunk_documents(spark.createDataFrame([("e", "")], "s string, t string"), "s", "t").count() == 0


def test_catalog_schema(spark):
    spark.createDataFrame([], "id int, d decimal(5,2), n struct<x:int>").createOrReplaceTempView("catalogued")
    found = schemas.schema_from_catalog(spark, ["catalogued"]).orderBy("pos").collect()
    assert [(r["column"], r["type"]) for r in found] == [("id", "long"), ("d", "decimal"), ("n", "string")]


def test_stream_gate_runs_again_without_repeating(spark, tmp_path):
    columns = "customer_id string, mail string, birth_date string, amount string"
    (tmp_path / "in").mkdir()

    def arrive(n):
        lines = ["customer_id,mail,birth_date,amount", *[",".join(r) for r in F2[:3]], "7,a@b.c,1990-01-02,1"]
        (tmp_path / "in" / f"f{n}.csv").write_text("\n".join(lines) + "\n")

    def run():
        stream = arrivals.arrivals(spark, str(tmp_path / "in"), columns, files_per_batch=1)
        arrivals.start_gate(stream, C2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows = arrivals.gated_rows(spark, str(tmp_path / "out"))
        return {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}

    arrive(1)
    arrive(2)
    assert run() == {"valid": 2, "quarantined": 6}
    assert run() == {"valid": 2, "quarantined": 6}
    arrive(3)
    assert run() == {"valid": 3, "quarantined": 9}
    alerts = arrivals.stream_alerts(spark, str(tmp_path / "out")).collect()
    assert sorted(a["batch"] for a in alerts) == [0, 1, 2] and {(a["arrived"], a["rejected"]) for a in alerts} == {(4, 3)}
    assert {a["text"] for a in alerts} == {"3 of 4 rows depart from `customers_contract`"}
    # a batch that is run again replaces its rows and its alert
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    assert run() == {"valid": 3, "quarantined": 9}
    assert len(arrivals.stream_alerts(spark, str(tmp_path / "out")).collect()) == 3
