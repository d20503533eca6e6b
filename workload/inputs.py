"""Inputs that the queries derive from the driver's tables.

* ``deliveries``: every order as one delivered row of a feed, all cells text, some of them bad.
* ``feeds`` / ``feed_columns``: every customer as one feed with its contract and the schema it
  declares, which drifts from the contract in names and types.

The text is the same for Spark and for the checking engine but for the few words in ``DIALECT``.
All row counts grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.types import Contract, Rule, rules_frame

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"

CUSTOMERS = Contract("customers_contract", [
    Rule("customer_id", "long", True),
    Rule("email", "string", True, pattern=EMAIL_PATTERN),
    Rule("birth_date", "date", True, format="%Y-%m-%d"),
    Rule("amount", "double", True, min_value="0", max_value="400000"),
    Rule("opt_in", "boolean"),
    Rule("visits", "int"),
    Rule("country", "string"),
], "1.0.0", "customer-data")

SUPPLIERS = Contract("supplier_payment_contract", [
    Rule("customer_id", "long", True),
    Rule("email", "string", True, pattern=EMAIL_PATTERN),
    Rule("birth_date", "date", True),
    Rule("amount", "decimal", True, min_value="1000"),
    Rule("priority", "string", allowed_values=["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
    Rule("visits", "int"),
    Rule("country", "string"),
], "1.0.0", "finance-data")

CONTRACTS = [CUSTOMERS, SUPPLIERS]

# every rule kind on the deliveries table itself
DELIVERY = Contract("delivery_contract", [
    Rule("customer_id", "long", True, min_value="1"),
    Rule("mail", "string", True, pattern=EMAIL_PATTERN),
    Rule("birth_date", "date", True, format="%Y-%m-%d"),
    Rule("amount", "double", True, min_value="0", max_value="400000"),
    Rule("opt_in", "boolean"),
    Rule("seen_at", "timestamp"),
    Rule("priority", "string", allowed_values=["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
], "1.0.0", "delivery")

#: Customers' feeds fall under so many contracts, which share most of their rules.
MANY = 300
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def numbered_contract(k: int) -> Contract:
    return Contract(f"rules-{k}", [
        Rule("customer_id", "long", k % 2 == 1, min_value=str(1 + k % 3)),
        Rule("mail", "string", k % 4 == 0, pattern=EMAIL_PATTERN),
        Rule("birth_date", "date", format="%Y-%m-%d" if k % 3 == 0 else ""),
        Rule("amount", "double", min_value="0", max_value=str(100_000 + 10_000 * (k % 30))),
        *([Rule("opt_in", "boolean", True)] if k % 5 else []),
        Rule("priority", "string", allowed_values=[p for n, p in enumerate(PRIORITIES) if n != k % 5]),
    ])


# the flags that say which columns are personal
PERSONAL = Contract("personal_contract", [
    Rule("customer_id", "long", True, pii=True), Rule("mail", "string", True, pii=True), Rule("birth_date", "date", pii=True),
    Rule("amount", "double"), Rule("priority", "string"), Rule("seen_at", "timestamp"), Rule("nowhere", "string", pii=True),
])

DOCUMENTS = Contract("documents_contract", [
    Rule("doc_id", "long", True, unique=True), Rule("text", "string", True), Rule("source", "string", pii=True), Rule("lang", "string"),
])

# typed tables
LINEITEM = Contract("lineitem_contract", [
    Rule("l_orderkey", "long", True),
    Rule("l_partkey", "long", True),
    Rule("l_suppkey", "long", True),
    Rule("l_linenumber", "int", True, min_value="1", max_value="6"),
    Rule("l_quantity", "double", True, min_value="2", max_value="49"),
    Rule("l_extendedprice", "decimal", True, min_value="1000"),
    Rule("l_discount", "double", min_value="0", max_value="0.09"),
    Rule("l_tax", "double", min_value="0", max_value="0.07"),
    Rule("l_returnflag", "string", allowed_values=["A", "N"]),
    Rule("l_linestatus", "string", pattern="[OF]"),
    Rule("l_shipdate", "timestamp", True),
], "1.0.0", "orders")

ORDERS = Contract("orders_contract", [
    Rule("o_orderkey", "long", True),
    Rule("o_custkey", "long", True),
    Rule("o_orderstatus", "string", True, allowed_values=["F", "O"]),
    Rule("o_totalprice", "double", True, min_value="1000", max_value="490000"),
    Rule("o_orderdate", "timestamp", True),
    Rule("o_orderpriority", "string", pattern=r"\d-.*"),
])

EVENTS = Contract("events_contract", [
    Rule("event_id", "long", True),
    Rule("ts", "timestamp", True),
    Rule("user_id", "int", True),
    Rule("event_type", "string", True, allowed_values=["click", "view", "purchase", "signup"]),
    Rule("value", "double", min_value="1", max_value="300"),
    Rule("props", "string", pattern=r'\{"k": \d{2}\}'),
])

CUSTOMER = Contract("customer_contract", [
    Rule("c_custkey", "long", True),
    Rule("c_name", "string", True),
    Rule("c_acctbal", "double", True, min_value="0"),
    Rule("c_mktsegment", "string", True, allowed_values=["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD"]),
])

SPARK = {"text": "string", "tab": "char(9)"}
DUCK = {"text": "varchar", "tab": "chr(9)"}

_DELIVERIES = """
SELECT o_orderkey AS k, o_orderkey + 2 AS "row", concat('feed-', CAST(o_custkey AS {text})) AS dataset,
  CASE WHEN o_custkey % 2 = 0 THEN 'customers_contract' ELSE 'supplier_payment_contract' END AS contract,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS {text})
       WHEN o_orderkey % 10 = 0 THEN ''
       WHEN o_orderkey % 10 = 1 THEN concat('ID-', CAST(o_custkey AS {text}))
       WHEN o_orderkey % 10 = 2 THEN concat('  ', CAST(o_custkey AS {text}), {tab})
       WHEN o_orderkey % 10 = 3 THEN '1_000'
       WHEN o_orderkey % 10 = 4 THEN '12.0'
       WHEN o_orderkey % 10 = 5 THEN concat({tab}, ' ')
       WHEN o_orderkey % 10 = 6 THEN '123456789012345678901234567890'
       ELSE CAST(o_custkey AS {text}) END AS customer_id,
  CASE WHEN o_orderkey % 8 = 0 THEN 'invalid-email'
       WHEN o_orderkey % 8 = 1 THEN concat(' u', CAST(o_orderkey AS {text}), '@example.com ')
       WHEN o_orderkey % 40 = 2 THEN NULL
       WHEN o_orderkey % 40 = 3 THEN concat('a', CAST(o_orderkey AS {text}), '@x@example.com')
       ELSE concat('u', CAST(o_orderkey AS {text}), '@example.com') END AS mail,
  CASE WHEN o_custkey % 3 <> 0 THEN '1990-01-02'
       WHEN o_orderkey % 6 = 0 THEN '01/01/1990'
       WHEN o_orderkey % 6 = 1 THEN '1990-1-2'
       WHEN o_orderkey % 12 = 2 THEN '1990-02-30'
       WHEN o_orderkey % 12 = 3 THEN '1990'
       ELSE CAST(CAST(o_orderdate AS date) AS {text}) END AS birth_date,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(CAST(o_totalprice + 2000 AS decimal(12,2)) AS {text})
       WHEN o_orderkey % 9 = 0 THEN 'bad'
       WHEN o_orderkey % 9 = 1 THEN 'NaN'
       WHEN o_orderkey % 9 = 2 THEN '1e3'
       WHEN o_orderkey % 9 = 3 THEN '-1_000.5'
       WHEN o_orderkey % 9 = 4 THEN concat('-', CAST(CAST(o_totalprice AS decimal(12,2)) AS {text}))
       WHEN o_orderkey % 9 = 5 THEN '1d'
       ELSE CAST(CAST(o_totalprice AS decimal(12,2)) AS {text}) END AS amount,
  CASE WHEN o_custkey % 3 <> 0 THEN 'TRUE' WHEN o_orderkey % 5 = 0 THEN 'yes' WHEN o_orderkey % 5 = 1 THEN 'maybe'
       WHEN o_orderkey % 5 = 2 THEN 't' WHEN o_orderkey % 5 = 3 THEN '0' ELSE 'False' END AS opt_in,
  CASE WHEN o_orderkey % 7 = 0 THEN '2024-01-01' WHEN o_orderkey % 7 = 1 THEN '2024-01-01T10:00:00Z'
       WHEN o_orderkey % 7 = 2 THEN '2024-01-01 25:00:00' WHEN o_orderkey % 7 = 3 THEN '2024-02-30T10:00:00'
       WHEN o_orderkey % 7 = 4 THEN '2024-01-01 10:00:00.123456+02:00' WHEN o_orderkey % 7 = 5 THEN '2024-01'
       ELSE '' END AS seen_at,
  o_orderpriority AS priority
FROM orders
"""

_FEEDS = """
SELECT concat('feed-', CAST(c_custkey AS {text})) AS dataset,
  CASE WHEN c_custkey % 2 = 0 THEN 'customers_contract' ELSE 'supplier_payment_contract' END AS contract
FROM customer
"""

# position, column name, type, present when; a third of the feeds keeps to its contract
_CLEAN = "c_custkey % 3 = 2"
_FEED_COLUMNS = [
    (0, f"CASE WHEN {_CLEAN} THEN 'customer_id' WHEN c_custkey % 4 = 0 THEN 'customer_id' WHEN c_custkey % 4 = 1 "
        "THEN 'CUSTOMER_ID' WHEN c_custkey % 4 = 2 THEN 'cust_id' ELSE 'Customer_Id' END",
     f"CASE WHEN {_CLEAN} OR c_custkey % 5 < 3 THEN 'BIGINT' WHEN c_custkey % 5 = 3 THEN 'string' ELSE 'int' END",
     "1 = 1"),
    (1, f"CASE WHEN {_CLEAN} THEN 'email' WHEN c_custkey % 5 = 0 THEN 'email' WHEN c_custkey % 5 = 1 THEN 'mail' "
        "WHEN c_custkey % 5 = 2 THEN 'e_mail' WHEN c_custkey % 5 = 3 THEN 'contact' ELSE 'emial' END",
     "CASE WHEN c_custkey % 2 = 0 THEN ' Varchar(64) ' ELSE 'text' END", "1 = 1"),
    (2, f"CASE WHEN {_CLEAN} THEN 'birth_date' WHEN c_custkey % 7 = 0 THEN 'BirthDate' WHEN c_custkey % 7 = 1 "
        "THEN 'brith_date' ELSE 'birth_date' END",
     f"CASE WHEN {_CLEAN} OR c_custkey % 2 = 0 THEN 'date' ELSE 'string' END", "1 = 1"),
    (3, f"CASE WHEN {_CLEAN} OR c_custkey % 6 < 4 THEN 'amount' ELSE 'amount_eur' END",
     f"CASE WHEN {_CLEAN} AND c_custkey % 2 = 0 THEN 'float64' WHEN {_CLEAN} THEN 'decimal(12,2)' "
     "WHEN c_custkey % 4 = 0 THEN 'double' WHEN c_custkey % 4 = 1 THEN 'float' ELSE 'decimal(12, 2)' END",
     "c_custkey % 19 <> 1"),
    (4, "'opt_in'", "CASE WHEN c_custkey % 5 = 0 THEN 'string' ELSE 'boolean' END", "c_custkey % 6 IN (0, 2, 4)"),
    (5, "'visits'", f"CASE WHEN {_CLEAN} THEN 'integer' WHEN c_custkey % 3 = 1 THEN 'long' ELSE 'int' END", "1 = 1"),
    (6, "'priority'", "'string'", "c_custkey % 2 = 1"),
    (7, "'country'", "'string'", f"{_CLEAN} OR c_custkey % 4 = 0"),
    (8, "concat(lower(c_mktsegment), ' Code')", "'smallint'", f"NOT ({_CLEAN}) AND c_custkey % 2 = 0"),
    (9, "'AMOUNT'", "'string'", f"NOT ({_CLEAN}) AND c_custkey % 11 = 0"),
    (10, "'countrycode'", "'string'", f"NOT ({_CLEAN}) AND c_custkey % 13 = 1"),
]


def _quoted(sql: str) -> str:
    """The double quotes of standard SQL names are back quotes in Spark."""
    return sql.replace('"', "`")


def deliveries_sql(dialect: dict) -> str:
    return _DELIVERIES.format(**dialect)


def feeds_sql(dialect: dict) -> str:
    return _FEEDS.format(**dialect)


def feed_columns_sql() -> str:
    """For the checking engine; Spark reads customer once and explodes."""
    return " UNION ALL ".join(
        f"SELECT concat('feed-', CAST(c_custkey AS varchar)) AS dataset, {pos} AS pos, {name} AS \"column\", "
        f"{kind} AS type, false AS required FROM customer WHERE {present}"
        for pos, name, kind, present in _FEED_COLUMNS
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(_quoted(sql).replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "orders", deliveries_sql(SPARK))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "customer", feeds_sql(SPARK))


def both(assignments: DataFrame) -> DataFrame:
    """Every dataset under both contracts."""
    names = F.array(*[F.lit(c.name) for c in CONTRACTS])
    return assignments.select("dataset", F.explode(names).alias("contract"))


BOTH_FEEDS = (
    f"SELECT dataset, contract FROM ({feeds_sql(DUCK)}) AS f(dataset, own), "
    f"(VALUES {', '.join(f'({chr(39)}{c.name}{chr(39)})' for c in CONTRACTS)}) AS c(contract)")
BOTH_DELIVERIES = (
    f"SELECT d.* REPLACE (c.contract AS contract) FROM ({deliveries_sql(DUCK)}) AS d, "
    f"(VALUES {', '.join(f'({chr(39)}{c.name}{chr(39)})' for c in CONTRACTS)}) AS c(contract)")


def feed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_compact(F.array(*[
        F.when(F.expr(present), F.struct(F.lit(pos).alias("pos"), F.expr(name).alias("column"),
                                         F.expr(kind).alias("type")))
        for pos, name, kind, present in _FEED_COLUMNS
    ]))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("feed-"), F.col("c_custkey").cast("string")).alias("dataset"), F.explode(entries).alias("c")
    ).select("dataset", "c.*", F.lit(False).alias("required"))


def rules(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, *CONTRACTS)
