"""Sources and arriving files.  Inputs are written from the tables by Spark, then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.session import work_folder
from pactum.sources import contracts, files, schemas
from pactum.streaming import arrivals
from workload import fixes, inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_CELLS = ["customer_id", "mail", "birth_date", "amount", "opt_in", "seen_at", "priority"]


def _deliveries_as_csv(spark: SparkSession, sf_dir: str) -> str:
    """Deliveries as CSV files, in key order within and across the files: as many as the session has partitions."""
    path = work_folder(spark, "deliveries-csv")
    inputs.deliveries(spark, sf_dir).repartitionByRange("k").sortWithinPartitions("k").select("k", *_CELLS).write.option(
        "header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.scan_csv(spark, _deliveries_as_csv(spark, sf_dir))
    return df.select("k", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _CELLS])


_register("scan_csv", scan_csv, oracle.query(
    "SELECT CAST(k AS varchar) AS k, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _CELLS) + " FROM deliveries",
    "deliveries"))

_register(
    "scan_parquet",
    lambda spark, sf: files.read_data(spark, f"{sf}/orders.parquet"),
    "SELECT * FROM orders")


def row_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record numbers across the files of a CSV dataset."""
    df = files.with_row_csv(files.scan_csv(spark, _deliveries_as_csv(spark, sf_dir)), across_files=True)
    return df.select(F.col("k").cast("long").alias("k"), "row")


_register("row_locator", row_locator, oracle.query(
    'SELECT k, row_number() OVER (ORDER BY k) + 1 AS "row" FROM deliveries', "deliveries"))

_register(
    "row_locator_parquet",
    lambda spark, sf: files.with_row_parquet(files.scan_parquet(spark, f"{sf}/orders.parquet")).select("o_orderkey", "row"),
    # the keys of the file count up from 0 in file order
    'SELECT o_orderkey, o_orderkey + 2 AS "row" FROM orders')

_register(
    "row_sample",
    lambda spark, sf: files.row_sample(inputs.deliveries(spark, sf), F.col("row")).select("row", "customer_id"),
    oracle.query('SELECT "row", customer_id FROM deliveries ORDER BY "row" LIMIT 1001', "deliveries"))


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every feed's text columns."""
    return schemas.infer_types(inputs.deliveries(spark, sf_dir), _CELLS, F.col("dataset"))


_v = "trim(value, concat(' ', chr(9)))"
_filled = "FILTER (value IS NOT NULL AND value <> '')"
_register("infer_types", infer_types, oracle.query(
    f"""
    SELECT dataset, pos, "column", CASE WHEN count(*) {_filled} = 0 THEN 'string'
        WHEN bool_and({oracle.type_ok('int', _v)}) {_filled} THEN 'long'
        WHEN bool_and({oracle.type_ok('double', _v)}) {_filled} THEN 'double'
        WHEN bool_and(lower({_v}) IN ('true', 'false')) {_filled} THEN 'boolean' ELSE 'string' END AS type,
      false AS required
    FROM cells GROUP BY dataset, pos, "column"
    """, "deliveries",
    cells=" UNION ALL ".join(
        f"SELECT dataset, {n} AS pos, '{c}' AS \"column\", {c} AS value FROM deliveries" for n, c in enumerate(_CELLS))))

# -- schemas -------------------------------------------------------------------------------------------

_TYPE = (
    "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'long' "
    "WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'double' WHEN data_type LIKE 'DECIMAL%' THEN 'decimal' "
    "WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' THEN 'date' "
    "WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'string' END")
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS row_count FROM {t}" for t in inputs.TABLES)
_SCHEMAS = f"""
    SELECT c.table_name AS dataset, CAST(c.ordinal_position - 1 AS integer) AS pos, c.column_name AS "column",
      {_TYPE} AS type, false AS required, n.row_count
    FROM information_schema.columns c JOIN ({_COUNTS}) n ON n.dataset = c.table_name
"""


def _with_row_counts(spark: SparkSession, sf_dir: str, meta: DataFrame) -> DataFrame:
    """The schemas beside the rows each table holds, which Parquet counts from its footers."""
    counts = reduce(DataFrame.unionByName, [
        inputs.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("dataset"), "row_count")
        for t in inputs.TABLES
    ])
    return meta.join(counts, "dataset")


def schema_from_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_row_counts(spark, sf_dir, schemas.schema_from_parquet(
        spark, {t: f"{sf_dir}/{t}.parquet" for t in inputs.TABLES}))


def schema_from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in inputs.TABLES:
        inputs.table(spark, sf_dir, t).createOrReplaceTempView(t)
    return _with_row_counts(spark, sf_dir, schemas.schema_from_catalog(spark, inputs.TABLES))


_register("schema_from_parquet", schema_from_parquet, _SCHEMAS)
_register("schema_from_catalog", schema_from_catalog, _SCHEMAS)

# documents that declare a schema or a contract, one per part
_SCHEMA_TEXT = """
SELECT concat('file-', CAST(p_partkey AS {text})) AS source, CASE
  WHEN p_size % 3 = 0 THEN concat('[{{"name": "part_key", "type": "long", "required": true}}, 7, {{"name": "',
    p_name, '"}}]')
  WHEN p_size % 3 = 1 THEN concat(' {{"name": "part ', CAST(p_partkey AS {text}),
    '", "columns": [{{"name": "A", "type": "", "required": "yes"}}, "x", {{"name": "B", "type": "', p_type,
    '", "required": 0}}]}} ')
  ELSE '{{"columns": []}}' END AS text
FROM part
"""


def schema_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _SCHEMA_TEXT.format(text="string").replace("FROM part", "FROM {part}").replace("{\"", "{{\"").replace(
        "}]", "}}]").replace("]}", "]}}").replace("}, ", "}}, ")
    documents = spark.sql(text, part=inputs.table(spark, sf_dir, "part"))
    return schemas.schema_from_json(documents, "source", "text")


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' documents broken in several ways: what is wrong with each; the others give their columns."""
    texts = F.expr("""CASE p_partkey % 7 WHEN 0 THEN concat('{"columns": [{"name": "', p_brand, '"')
        WHEN 1 THEN '{"fields": []}' WHEN 2 THEN '{"columns": {"a": 1}}' WHEN 3 THEN '[{"type": "int"}]' WHEN 4 THEN ' '
        WHEN 5 THEN concat('[{"name": "', p_brand, '", "required": 2}]')
        ELSE '{"name": "six", "columns": [1, {"name": "a", "required": [0]}, {"name": "b", "required": "2"}]}' END""")
    documents = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), texts.alias("text"))
    wrong = schemas.schema_errors(documents, "source", "text")
    right = schemas.schema_from_json(documents, "source", "text", strict=False)
    return wrong.unionByName(right.select(F.col("dataset").alias("source"), F.concat("column", F.lit(" "), F.col("required").cast("string")).alias("error")))


_register("schema_errors", schema_errors, """
    SELECT CASE WHEN m = 6 THEN 'six' ELSE CAST(p_partkey AS varchar) END AS source, error FROM (
      SELECT p_partkey, p_partkey % 7 AS m, unnest(CASE p_partkey % 7 WHEN 0 THEN ['not a JSON document']
        WHEN 1 THEN ['neither a list of columns nor an object with columns'] WHEN 2 THEN ['columns must be a list']
        WHEN 3 THEN ['column name is missing'] WHEN 4 THEN ['not a JSON document'] WHEN 5 THEN [p_brand || ' true']
        ELSE ['a true', 'b false'] END) AS error FROM part)""")
_register("schema_from_json", schema_from_json, """
    SELECT concat('file-', CAST(p_partkey AS varchar)) AS dataset, 0 AS pos, 'part_key' AS "column", 'long' AS type,
      true AS required FROM part WHERE p_size % 3 = 0
    UNION ALL
    SELECT concat('file-', CAST(p_partkey AS varchar)), 1, p_name, 'string', false FROM part WHERE p_size % 3 = 0
    UNION ALL
    SELECT concat('part ', CAST(p_partkey AS varchar)), 0, 'A', 'string', true FROM part WHERE p_size % 3 = 1
    UNION ALL
    SELECT concat('part ', CAST(p_partkey AS varchar)), 1, 'B', p_type, false FROM part WHERE p_size % 3 = 1
    """)


def _contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract document per part: half of them JSON, half YAML, with the spellings in use."""
    key = F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    as_json = F.concat(
        F.lit('{"name": "part-'), key, F.lit('", "version": "2.0", "columns": [{"name": "key", "type": "long", '
              '"required": true, "min": '), key, F.lit('}, {"name": "brand", "required": "required", '
              '"allowedValues": ["'), F.col("p_brand"), F.lit('", "other"]}, {"name": "price", "type": "double", '
              '"minValue": "0", "max_value": '), price, F.lit("}]}"))
    as_yaml = F.concat(
        F.lit("dataset: part-"), key, F.lit("\nowner: makers\ncolumns:\n  - name: key\n    type: long\n"
              "    required: yes\n    min_value: "), key, F.lit("\n    unique: true\n  - name: kind\n    pii: true\n"
              "    allowed_values:\n      - "), F.col("p_type"), F.lit("\n      - other\n    checks:\n"
              "      - type: regex\n        pattern: \"[A-Z]+\"\n  - {name: made_on, type: date, format: '%d/%m/%Y'}\n"))
    is_json = F.col("p_size") % 2 == 0
    return inputs.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), key).alias("source"), is_json.alias("is_json"),
        F.when(is_json, as_json).otherwise(as_yaml).alias("text"))


def load_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _contract_documents(spark, sf_dir)
    as_json = documents.filter("is_json").select("source", F.col("text").alias("json"))
    from_yaml = contracts.yaml_as_json(documents.filter("NOT is_json"))
    rules = contracts.contract_rules(as_json.unionByName(from_yaml))
    return rules.select(
        "contract", "version", "owner", "pos", "column", "type", "required", "format", "pattern",
        F.array_join("allowed_values", ",").alias("allowed"), "min_value", "max_value", "unique", "pii")


_K = "CAST(p_partkey AS varchar)"
_register("load_contracts", load_contracts, f"""
    SELECT concat('part-', {_K}) AS contract, CASE WHEN p_size % 2 = 0 THEN '2.0' ELSE '0.1.0' END AS version,
      CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE 'makers' END AS owner, 0 AS pos, 'key' AS "column", 'long' AS type,
      true AS required, '' AS format, '' AS pattern, '' AS allowed, {_K} AS min_value, '' AS max_value,
      p_size % 2 <> 0 AS "unique", false AS pii FROM part
    UNION ALL
    SELECT concat('part-', {_K}), '2.0', 'unknown', 1, 'brand', 'string', true, '', '', concat(p_brand, ',other'),
      '', '', false, false FROM part WHERE p_size % 2 = 0
    UNION ALL
    SELECT concat('part-', {_K}), '2.0', 'unknown', 2, 'price', 'double', false, '', '', '', '0',
      CAST(CAST(CAST(p_retailprice AS decimal(12,2)) AS double) AS varchar), false, false FROM part WHERE p_size % 2 = 0
    UNION ALL
    SELECT concat('part-', {_K}), '0.1.0', 'makers', 1, 'kind', 'string', false, '', '[A-Z]+',
      concat(p_type, ',other'), '', '', false, true FROM part WHERE p_size % 2 <> 0
    UNION ALL
    SELECT concat('part-', {_K}), '0.1.0', 'makers', 2, 'made_on', 'date', false, '%d/%m/%Y', '', '', '', '', false,
      false FROM part WHERE p_size % 2 <> 0
    """)

# -- listing, admission, arrivals -------------------------------------------------------------------------


def _orders_by_status(spark: SparkSession, sf_dir: str) -> str:
    path = work_folder(spark, "orders-by-status")
    inputs.table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").option("maxRecordsPerFile", 200_000).option(
        "header", True).csv(path)
    return path


def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List the files of a prefix, then count the rows that lie in them."""
    path = _orders_by_status(spark, sf_dir)
    listed = files.list_objects(spark, path, "part-").filter(F.col("size") > 0)
    rows = files.scan_csv(spark, path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"))
    return listed.join(rows, "path").groupBy(
        F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status")).agg(F.sum("rows").alias("rows"))


_register("list_objects", list_objects,
          "SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY o_orderstatus")


def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the written files by admission verdict."""
    path = _orders_by_status(spark, sf_dir)
    judged = files.admit_files(
        files.list_objects(spark, path, "part-"), max_bytes=1 << 40, roots=[f"{path}/o_orderstatus=F", f"{path}/o_orderstatus=P"])
    rows = files.scan_csv(spark, path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"))
    return judged.join(rows, "path").groupBy(F.coalesce("reason", F.lit("admitted")).alias("verdict")).agg(
        F.sum("rows").alias("rows"))


_register("admit_files", admit_files, """
    SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'admitted' ELSE 'outside_root' END AS verdict, count(*) AS rows
    FROM orders GROUP BY ALL""")


def _gated(spark: SparkSession, sf_dir: str) -> str:
    source = _deliveries_as_csv(spark, sf_dir)
    schema = "k string, " + ", ".join(f"{c} string" for c in _CELLS)
    stream = arrivals.arrivals(spark, source, schema, files_per_batch=8)
    out = work_folder(spark, "gate-out")
    arrivals.start_gate(stream, inputs.DELIVERY, out, work_folder(spark, "gate-state")).awaitTermination()
    return out


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries arrive as CSV files and pass the gate; both outcomes are read back, and what the alerts of all
    batches add up to."""
    out = _gated(spark, sf_dir)
    alerts = arrivals.stream_alerts(spark, out).agg(F.sum("rejected").alias("rejected"), F.sum("arrived").alias("arrived"))
    return arrivals.gated_rows(spark, out).select(
        F.col("k").cast("long").alias("k"), "verdict", F.array_join("reasons", ",").alias("reasons")).unionByName(
        alerts.select(F.lit(None).cast("long").alias("k"), F.lit("alert").alias("verdict"), F.concat_ws(" of ", "rejected", "arrived").alias("reasons")))


_register("stream_gate", stream_gate, oracle.query(
    "SELECT k, CASE WHEN reasons = '' THEN 'valid' ELSE 'quarantined' END AS verdict, reasons FROM judged "
    "UNION ALL SELECT NULL, 'alert', concat(count(*) FILTER (reasons <> ''), ' of ', count(*)) FROM judged",
    "deliveries", judged=f"SELECT k, {fixes._reasons(inputs.DELIVERY)} AS reasons FROM deliveries"))
