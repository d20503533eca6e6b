"""Corrections carried out on the deliveries, and the plan applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import profile, remediate
from pactum.sources import schemas
from pactum.plans import validate
from pactum.types import Contract
from workload import inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, run, sql: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = sql


def _strip(c: str) -> str:
    return oracle.STRIP.format(v=c)


_register(
    "fix_rename",
    lambda spark, sf: remediate.fix_rename(inputs.deliveries(spark, sf), {"mail": "email", "priority": "rank"}).select(
        "row", "email", "rank"),
    oracle.query('SELECT "row", mail AS email, priority AS rank FROM deliveries', "deliveries"))

_ID = _strip("customer_id")
_AMOUNT = _strip("amount")
_FLAG = f"lower({_strip('opt_in')})"
_CAST = f"""
    CASE WHEN {oracle.type_ok('long', _ID)} THEN try_cast(replace({_ID}, '_', '') AS bigint) END AS customer_id,
    CASE WHEN {_FLAG} IN ('true', '1', 'yes') THEN true WHEN {_FLAG} IN ('false', '0', 'no') THEN false END AS opt_in,
    CASE WHEN {oracle.type_ok('date', _strip('birth_date'))} THEN try_cast({_strip('birth_date')} AS date) END
      AS birth_date"""
_register(
    "fix_cast",
    lambda spark, sf: remediate.fix_cast(
        inputs.deliveries(spark, sf), {"customer_id": "long", "opt_in": "boolean", "birth_date": "date"}
    ).select("row", "customer_id", "opt_in", "birth_date"),
    oracle.query(f'SELECT "row", {_CAST} FROM deliveries', "deliveries"))

_register(
    "fix_value_type",
    lambda spark, sf: remediate.fix_value_type(inputs.deliveries(spark, sf), "amount", "decimal(12,2)").select(
        "row", F.col("amount").cast("double").alias("amount")),
    oracle.query(
        f"SELECT \"row\", CASE WHEN {oracle.type_ok('decimal', _AMOUNT)} AND NOT "
        f"isnan(try_cast(replace({_AMOUNT}, '_', '') AS double)) "
        f"THEN try_cast(replace({_AMOUNT}, '_', '') AS double) END AS amount FROM deliveries", "deliveries"))

_register(
    "fix_date_format",
    lambda spark, sf: remediate.fix_date_format(
        inputs.deliveries(spark, sf), "birth_date", "%Y-%m-%d", ["%d/%m/%Y"]
    ).select("row", "birth_date"),
    oracle.query(
        "SELECT \"row\", CAST(coalesce(try_strptime(birth_date, '%Y-%m-%d'), try_strptime(birth_date, '%d/%m/%Y')) "
        "AS date) AS birth_date FROM deliveries", "deliveries"))


def quarantine_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, invalid = remediate.quarantine_required(inputs.deliveries(spark, sf_dir), ["customer_id", "mail"])
    return valid.select("row", F.lit("valid").alias("verdict")).unionByName(
        invalid.select("row", F.lit("quarantined").alias("verdict")))


_register("quarantine_required", quarantine_required, oracle.query(
    f"SELECT \"row\", CASE WHEN coalesce({_strip('customer_id')}, '') = '' OR coalesce({_strip('mail')}, '') = '' "
    "THEN 'quarantined' ELSE 'valid' END AS verdict FROM deliveries", "deliveries"))


def reject_below_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, invalid = remediate.reject_below_min(inputs.deliveries(spark, sf_dir), "amount", "1000.5")
    return valid.select("row", F.lit("valid").alias("verdict")).unionByName(
        invalid.select("row", F.lit("rejected").alias("verdict")))


_register("reject_below_min", reject_below_min, oracle.query(
    f"SELECT \"row\", CASE WHEN {oracle.type_ok('double', _AMOUNT)} AND "
    f"try_cast(replace({_AMOUNT}, '_', '') AS double) < 1000.5 THEN 'rejected' "
    "ELSE 'valid' END AS verdict FROM deliveries", "deliveries"))

_register(
    "drop_extra",
    lambda spark, sf: remediate.drop_extra(inputs.deliveries(spark, sf), inputs.DELIVERY),
    oracle.query(
        "SELECT customer_id, mail, birth_date, amount, opt_in, seen_at, priority FROM deliveries", "deliveries"))


def _reasons(contract, columns=None) -> str:
    parts = [
        f"'{r.column}:' || {oracle.cell_case(r, r.column)}" for r in contract.rules
        if columns is None or r.column in columns
    ]
    return f"concat_ws(',', {', '.join(parts)})"


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the deliveries under all rules, with reasons."""
    valid, bad = remediate.quarantine_split(inputs.deliveries(spark, sf_dir), inputs.DELIVERY)
    return valid.select("row", F.lit("").alias("reasons")).unionByName(
        bad.select("row", F.array_join("reasons", ",").alias("reasons")))


_register("quarantine_split", quarantine_split, oracle.query(
    f'SELECT "row", {_reasons(inputs.DELIVERY)} AS reasons FROM deliveries', "deliveries"))


def quarantine_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the largest table by reason."""
    marked = remediate.with_reasons(inputs.table(spark, sf_dir, "lineitem"), inputs.LINEITEM)
    return marked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


_register("quarantine_lineitem", quarantine_lineitem, (
    "SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', "
    + ", ".join(f"'{r.column}:' || {oracle.typed_case(r, r.column)}" for r in inputs.LINEITEM.rules)
    + ") AS reasons FROM lineitem) GROUP BY reasons"))


def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate the deliveries as one dataset, then carry out the plan its report asks for."""
    df = inputs.deliveries(spark, sf_dir).select("row", "customer_id", "mail", "birth_date", "amount", "opt_in")
    contract = inputs.CUSTOMERS
    received = schemas.infer_types(df.drop("row"), dataset=F.lit("deliveries"))
    valid, rejected = validate.remediate_dataset(
        spark, "deliveries", df, contract, F.col("row"), received, {"birth_date": ["%d/%m/%Y"]}, warn_extra_columns=False)
    return valid.select("row", F.col("customer_id").cast("string").alias("customer_id"), "email", "birth_date",
                        F.nanvl("amount", F.lit(None)).alias("amount"), F.lit("valid").alias("verdict")).unionByName(
        rejected.select("row", "customer_id", "email", F.lit(None).cast("date").alias("birth_date"),
                        F.lit(None).cast("double").alias("amount"), F.lit("rejected").alias("verdict")))


_NUMBER = f"CASE WHEN {oracle.type_ok('double', _AMOUNT)} THEN try_cast(replace({_AMOUNT}, '_', '') AS double) END"
_OUT = f"(coalesce({_ID}, '') = '' OR coalesce({_NUMBER} < 0, false))"
_register("apply_plan", apply_plan, oracle.query(
    f"""
    SELECT "row", CASE WHEN {_OUT} THEN customer_id WHEN {oracle.type_ok('long', _ID)}
        THEN CAST(try_cast(replace({_ID}, '_', '') AS bigint) AS varchar) END AS customer_id,
      mail AS email,
      CASE WHEN NOT {_OUT} THEN CAST(coalesce(try_strptime(birth_date, '%Y-%m-%d'),
        try_strptime(birth_date, '%d/%m/%Y')) AS date) END AS birth_date,
      CASE WHEN NOT {_OUT} AND NOT isnan({_NUMBER}) THEN {_NUMBER} END AS amount,
      CASE WHEN {_OUT} THEN 'rejected' ELSE 'valid' END AS verdict
    FROM deliveries
    """, "deliveries"))

# -- personal data -----------------------------------------------------------------------------------

# what the queries must find, said in the checking engine's own way (it never goes back in a text)
_LOCAL, _LABEL = "[a-zA-Z0-9._%+-]", "[a-zA-Z0-9-]"
_EMAIL = f"{_LOCAL}+@{_LABEL}+([.]{_LABEL}+)*[.][a-zA-Z][a-zA-Z]+"
_SSN = r"\b\d\d\d-\d\d-\d\d\d\d\b"
_PHONE = r"([+]\d\d?\d?[ .-]?)?([(]\d\d\d[)]|\b\d\d\d)[ .-]\d\d\d[ .-]\d\d\d\d\b"


def _found(column: str) -> str:
    return ", ".join(
        f"coalesce(len(regexp_extract_all({column}, '{pattern}')), 0) AS {name}"
        for name, pattern in [("emails", _EMAIL), ("ssns", _SSN), ("phones", _PHONE)])


def _masked(column: str) -> str:
    for word, pattern in [("<email>", _EMAIL), ("<ssn>", _SSN), ("<phone>", _PHONE)]:
        column = f"regexp_replace({column}, '{pattern}', '{word}', 'g')"
    return column


_register(
    "detect_pii",
    lambda spark, sf: profile.pii_counts(inputs.table(spark, sf, "documents"), "doc_id", "text"),
    f"SELECT * FROM (SELECT doc_id, {_found('text')} FROM documents) WHERE emails > 0 OR ssns > 0 OR phones > 0")
_register(
    "mask_pii",
    lambda spark, sf: remediate.mask_pii(inputs.table(spark, sf, "documents"), ["text"]).select("doc_id", "text"),
    f"SELECT doc_id, {_masked('text')} AS text FROM documents")
_register(
    "mask_pii_events",
    lambda spark, sf: remediate.mask_pii(inputs.deliveries(spark, sf), ["mail"]).select("row", "mail"),
    oracle.query(f"SELECT \"row\", {_masked('mail')} AS mail FROM deliveries", "deliveries"))


def _review(contract: Contract, source: str, columns: list[str]) -> str:
    flags = {r.column: r.pii for r in contract.rules}
    return " UNION ALL ".join(
        f"SELECT '{source}' AS dataset, '{contract.name}' AS contract, '{c}' AS \"column\", count(v) AS cells, "
        f"count(*) FILTER (emails + ssns + phones > 0) AS cells_with_pii, CAST(coalesce(sum(emails), 0) AS bigint) AS emails, "
        f"CAST(coalesce(sum(ssns), 0) AS bigint) AS ssns, CAST(coalesce(sum(phones), 0) AS bigint) AS phones, {flags[c]} AS flagged, "
        f"CASE WHEN count(*) FILTER (emails + ssns + phones > 0) > 0 THEN '{'declared' if flags[c] else 'undeclared'}' "
        f"ELSE '{'unseen' if flags[c] else 'none'}' END AS verdict "
        f"FROM (SELECT CAST({c} AS varchar) AS v, {_found(f'CAST({c} AS varchar)')} FROM {source})" for c in columns)


_register(
    "pii_review",
    lambda spark, sf: profile.pii_review(inputs.deliveries(spark, sf), inputs.PERSONAL, F.lit("deliveries")),
    oracle.query(_review(inputs.PERSONAL, "deliveries", ["customer_id", "mail", "birth_date", "amount", "priority", "seen_at"]), "deliveries"))
_register(
    "pii_review_documents",
    lambda spark, sf: profile.pii_review(inputs.table(spark, sf, "documents"), inputs.DOCUMENTS, F.lit("documents")),
    _review(inputs.DOCUMENTS, "documents", ["doc_id", "text", "source", "lang"]))


def _flagged(column: str) -> str:
    blank = f"coalesce({_strip(column)}, '') = ''"
    return f"CASE WHEN NOT ({blank}) AND {_masked(column)} = {column} THEN '<masked>' ELSE {_masked(column)} END AS {column}"


_register(
    "mask_flagged",
    lambda spark, sf: remediate.mask_flagged(inputs.deliveries(spark, sf), inputs.PERSONAL).select(
        "row", "customer_id", "mail", "birth_date", "amount", "priority"),
    oracle.query(
        f'SELECT "row", {_flagged("customer_id")}, {_flagged("mail")}, {_flagged("birth_date")}, amount, priority FROM deliveries', "deliveries"))
_register(
    "drop_flagged",
    lambda spark, sf: remediate.drop_pii(inputs.deliveries(spark, sf), inputs.PERSONAL),
    oracle.query('SELECT k, "row", dataset, contract, amount, opt_in, seen_at, priority FROM deliveries', "deliveries"))
