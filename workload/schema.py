"""Schema comparison over the fleet of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions import names
from pactum.operators import schema_diff as sd
from pactum.types import Contract, Rule
from workload import inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def _fleet(spark: SparkSession, sf_dir: str):
    return inputs.feeds(spark, sf_dir), inputs.rules(spark), inputs.feed_columns(spark, sf_dir)


def normalize_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.feed_columns(spark, sf_dir).select("dataset", "pos", "type", names.type_form(F.col("type")).alias("normal"))


QUERIES["normalize_types"] = normalize_types
ORACLES["normalize_types"] = oracle.query(
    f"SELECT dataset, pos, type, {oracle.norm_type('type')} AS normal FROM feed_columns", "feed_columns")


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.feed_columns(spark, sf_dir).select("dataset", "pos", "column", names.name_form(F.col("column")).alias("form"))


QUERIES["normalize_names"] = normalize_names
ORACLES["normalize_names"] = oracle.query(
    f'SELECT dataset, pos, "column", {oracle.name_form(chr(34) + "column" + chr(34))} AS form FROM feed_columns',
    "feed_columns")


def matched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.matched_columns(*_fleet(spark, sf_dir)).select(
        "dataset", "contract", "exp_pos", "exp_column", "exp_type", "src_pos", "src_column", "src_type")


QUERIES["matched_columns"] = matched_columns
ORACLES["matched_columns"] = oracle.query(
    "SELECT dataset, contract, exp_pos, exp_column, exp_type, src_pos, src_column, src_type FROM matched", "matched")


def _finding_query(name: str, check: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*_fleet(spark, sf_dir)).select("dataset", "contract", "pos", "severity", "column", "expected", "actual")

    QUERIES[name] = run
    ORACLES[name] = oracle.query(
        'SELECT dataset, contract, pos, severity, "column", expected, actual FROM findings '
        f"WHERE \"check\" = {oracle.quote(check)}", "findings")


_finding_query("missing_columns", fixed.MISSING, sd.missing_columns)
_finding_query("extra_columns", fixed.EXTRA, sd.extra_columns)


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.renamed_columns(sd.aligned(*_fleet(spark, sf_dir))).select(
        "dataset", "exp_pos", "exp_column", "src_pos", "src_column")


QUERIES["renamed_columns"] = renamed_columns
ORACLES["renamed_columns"] = oracle.query(
    "SELECT dataset, exp_pos, exp_column, src_pos, src_column FROM renamed", "renamed")


def rename_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.rename_similarity(sd.aligned(*_fleet(spark, sf_dir)))


QUERIES["rename_similarity"] = rename_similarity
ORACLES["rename_similarity"] = oracle.query("SELECT DISTINCT dataset, exp_column, src_column FROM lookalikes", "lookalikes")


def rename_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.rename_confidence(sd.aligned(*_fleet(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


QUERIES["rename_confidence"] = rename_confidence
ORACLES["rename_confidence"] = oracle.query(
    "SELECT dataset, exp_column, src_column, "
    "round(1 - levenshtein(l, r)::double / greatest(length(l), length(r)), 6) AS confidence FROM renamed", "renamed")


def _type_query(name: str, check: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sd.type_issues(sd.matched_columns(*_fleet(spark, sf_dir)), check).select(
            "dataset", "exp_column", "exp_type", "src_type")

    QUERIES[name] = run
    ORACLES[name] = oracle.query(
        'SELECT dataset, "column" AS exp_column, expected AS exp_type, actual AS src_type FROM findings '
        f"WHERE \"check\" = {oracle.quote(check)}", "findings")


_type_query("type_changes", fixed.TYPE_CHANGE)
_type_query("type_promotions", fixed.PROMOTION)


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.schema_diff(*_fleet(spark, sf_dir)).select(
        "dataset", "contract", "ord", "severity", "check", "column", "expected", "actual")


QUERIES["schema_diff"] = schema_diff
ORACLES["schema_diff"] = oracle.query(
    "SELECT dataset, contract, row_number() OVER (PARTITION BY dataset ORDER BY phase, pos) AS ord, severity, "
    '"check", "column", expected, actual FROM findings', "findings")


def schema_diff_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions count as changes and undeclared columns are not reported."""
    return sd.schema_findings(*_fleet(spark, sf_dir), allow_safe_promotion=False, warn_extra_columns=False).select(
        "dataset", "pos", "severity", "check", "column")


QUERIES["schema_diff_strict"] = schema_diff_strict
ORACLES["schema_diff_strict"] = oracle.query(
    "SELECT dataset, pos, CASE WHEN \"check\" = 'type.promotion' THEN 'FAIL' ELSE severity END AS severity, "
    "CASE WHEN \"check\" = 'type.promotion' THEN 'type.change' ELSE \"check\" END AS \"check\", \"column\" "
    "FROM findings WHERE \"check\" <> 'column.extra'", "findings")


def check_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.naming_violations(inputs.feed_columns(spark, sf_dir)).select("dataset", "pos", "column")


QUERIES["check_naming"] = check_naming
ORACLES["check_naming"] = oracle.query(
    'SELECT dataset, pos, "column" FROM feed_columns '
    "WHERE NOT regexp_full_match(\"column\", '[a-z][a-z0-9]*(_[a-z0-9]+)*')", "feed_columns")

# -- two contract versions of every part ------------------------------------------------------------

_VERSIONS = """
SELECT concat('part-', CAST(p_partkey AS {text})) AS contract, 0 AS pos, 'part_key' AS "column",
  CASE WHEN {new} AND p_partkey % 5 = 0 THEN 'string' WHEN {new} AND p_partkey % 5 = 1 THEN 'BIGINT' ELSE 'long' END
    AS type, 1 = 1 AS required, '' AS format FROM part
UNION ALL
SELECT concat('part-', CAST(p_partkey AS {text})), 1, CASE WHEN {new} AND p_size % 3 = 0 THEN 'Brand' ELSE 'brand' END,
  'string', CASE WHEN {new} THEN p_size % 7 = 0 ELSE p_size % 5 = 0 END, '' FROM part
UNION ALL
SELECT concat('part-', CAST(p_partkey AS {text})), 2, 'made_on', 'date', 1 = 0,
  CASE WHEN {new} AND p_partkey % 4 = 0 THEN '%d/%m/%Y' ELSE '%Y-%m-%d' END FROM part
  WHERE NOT ({new} AND p_partkey % 9 = 0)
UNION ALL
SELECT concat('part-', CAST(p_partkey AS {text})), 3, CASE WHEN {new} THEN 'price' ELSE 'cost' END, 'double',
  p_size % 2 = 0, '' FROM part WHERE p_partkey % 3 = 0
"""


def _version(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    sql = _VERSIONS.format(text="string", new="(1 = 1)" if new else "(1 = 0)").replace('"', "`")
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=inputs.table(spark, sf_dir, "part"))


def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.breaking_changes(_version(spark, sf_dir, False), _version(spark, sf_dir, True))


QUERIES["breaking_changes"] = breaking_changes
ORACLES["breaking_changes"] = oracle.query(
    """
    SELECT contract, "column", change,
      CASE WHEN change IN ('required column removed', 'required column added', 'became required') THEN 'breaking'
           WHEN change IN ('type changed', 'format changed') THEN 'potentially breaking' ELSE 'compatible' END AS grade
    FROM (
      SELECT contract, coalesce(n."column", o."column") AS "column",
        CASE WHEN n."column" IS NULL AND o.required THEN 'required column removed'
             WHEN n."column" IS NULL THEN 'optional column removed'
             WHEN o."column" IS NULL AND n.required THEN 'required column added'
             WHEN o."column" IS NULL THEN 'optional column added'
             WHEN replace(lower(o.type), 'bigint', 'long') <> replace(lower(n.type), 'bigint', 'long')
               THEN 'type changed'
             WHEN o.format <> n.format THEN 'format changed'
             WHEN NOT o.required AND n.required THEN 'became required'
             WHEN o.required AND NOT n.required THEN 'became optional' END AS change
      FROM olds o FULL JOIN news n USING (contract, key))
    WHERE change IS NOT NULL
    """,
    olds='SELECT *, lower("column") AS key FROM (' + _VERSIONS.format(text="varchar", new="(1 = 0)") + ")",
    news='SELECT *, lower("column") AS key FROM (' + _VERSIONS.format(text="varchar", new="(1 = 1)") + ")")
