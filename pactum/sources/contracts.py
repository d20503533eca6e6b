"""Contracts written in JSON or YAML, loaded as ``contract_rules``."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions.text import strip
from pactum.sources.schemas import flag

try:
    import yaml
except ImportError:  # YAML contracts need the library, JSON contracts do not
    yaml = None

# the library's compiled loader where it has one, with every scalar kept as text
_LOADER = getattr(yaml, "CBaseLoader", None) or getattr(yaml, "BaseLoader", None)

_DOCUMENT = "name string, dataset string, version string, owner string, criticality string, columns string"
_COLUMN = (
    "name string, type string, required string, description string, format string, pattern string, "
    "allowed_values string, allowedValues string, min string, min_value string, minValue string, "
    "max string, max_value string, maxValue string, unique string, pii string, "
    "checks array<struct<type:string,pattern:string>>"
)


def _plain_yaml(node):
    """Scalars stay text; only true/false and the null words have a meaning of their own."""
    if isinstance(node, dict):
        return {str(k): _plain_yaml(v) for k, v in node.items()}
    if isinstance(node, list):
        return [_plain_yaml(v) for v in node]
    word = str(node).strip().lower()
    if word in ("true", "false"):
        return word == "true"
    return None if word in ("null", "none", "~") else node


def _yaml_to_json(batches: Iterator) -> Iterator:
    for batch in batches:
        batch["json"] = [json.dumps(_plain_yaml(yaml.load(t, Loader=_LOADER))) for t in batch["text"]]
        yield batch[["source", "json"]]


def yaml_as_json(documents: DataFrame) -> DataFrame:
    """Documents (source, text) in YAML as (source, json)."""
    if yaml is None:
        raise ValueError("YAML contracts need the PyYAML library")
    return documents.select("source", "text").mapInPandas(_yaml_to_json, "source string, json string")


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _list(value: Column) -> Column:
    """A JSON list of anything, or a single value, as a list of texts."""
    return F.when(strip(value).startswith("["), F.from_json(value, "array<string>")).when(
        value.isNotNull() & (value != ""), F.array(value)
    ).otherwise(F.array().cast("array<string>"))


def _full_pattern(column: Column) -> Column:
    """The column's own pattern; regex checks listed under it must hold as well.

    A cell is stripped before it is matched, so the ``$`` of a lookahead is the end of the cell.
    """
    listed = F.transform(
        F.filter(column["checks"], lambda c: (c["type"] == "regex") & (c["pattern"] != "")), lambda c: c["pattern"]
    )
    every = F.array_compact(F.concat(F.array(_filled(column["pattern"])),
                                     F.coalesce(listed, F.array().cast("array<string>"))))
    ahead = F.array_join(
        F.transform(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))),
                    lambda p: F.concat(F.lit("(?=(?:"), p, F.lit(")$)"))), "")
    last = F.element_at(every, -1)
    return F.when(F.size(every) == 0, F.lit("")).when(F.size(every) == 1, last).otherwise(
        F.concat(ahead, F.lit("(?:"), last, F.lit(")"))
    )


def _parsed(documents: DataFrame) -> DataFrame:
    return documents.select("source", F.from_json("json", _DOCUMENT).alias("d")).select(
        "source", "d", F.from_json("d.columns", "array<string>").alias("items")
    )


def contract_errors(documents: DataFrame) -> DataFrame:
    """Documents that are no contract, with the reason: ``columns`` not a list, or a column
    without a name."""
    nameless = F.exists("items", lambda x: x.startswith("{") & F.coalesce(
        F.from_json(x, "name string")["name"] == "", F.lit(True)))
    reason = F.when(F.coalesce(F.col("d.columns"), F.lit("")).isin("", "null", "false", "0", "{}"), None).when(
        ~strip(F.col("d.columns")).startswith("["), F.lit("columns must be a list")
    ).when(nameless, F.lit("column name is missing"))
    return _parsed(documents).select("source", reason.alias("error")).filter(F.col("error").isNotNull())


def contract_rules(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Rules of contract documents (source, json), one row per contract column.

    ``strict`` stops at a document that is no contract; otherwise such documents are left out and
    can be listed with ``contract_errors``.
    """
    parsed = _parsed(documents)
    is_list = strip(F.col("d.columns")).startswith("[")
    nothing = F.coalesce(F.col("d.columns"), F.lit("")).isin("", "null", "false", "0", "{}")
    if strict:
        items = F.when(is_list, F.col("items")).when(nothing, F.array().cast("array<string>")).otherwise(
            F.raise_error(F.concat(F.lit("contract columns must be a list: "), F.col("source"))))
    else:
        parsed = parsed.filter(is_list | nothing)
        items = F.col("items")
    objects = F.filter(items, lambda x: strip(x).startswith("{"))
    rows = parsed.select(
        "source",
        F.coalesce(_filled(F.col("d.name")), _filled(F.col("d.dataset")),
                   F.lit(fixed.DEFAULT_CONTRACT_NAME)).alias("contract"),
        F.coalesce(_filled(F.col("d.version")), F.lit(fixed.DEFAULT_VERSION)).alias("version"),
        F.coalesce(_filled(F.col("d.owner")), F.lit(fixed.DEFAULT_OWNER)).alias("owner"),
        F.coalesce(_filled(F.col("d.dataset")), _filled(F.col("d.name"))).alias("dataset"),
        F.coalesce(F.col("d.criticality"), F.lit("")).alias("criticality"),
        F.posexplode(objects).alias("pos", "item"),
    ).withColumn("c", F.from_json("item", _COLUMN))
    name = _filled(F.col("c.name"))
    if strict:
        name = F.coalesce(name, F.raise_error(F.concat(F.lit("column name is missing: "), F.col("source"))))
    else:
        bad = contract_errors(documents).select("source")
        rows = rows.join(bad, "source", "left_anti")

    def bound(side: str) -> Column:
        """Of the key that comes first in this order among those present, be it null."""
        keys, found = F.json_object_keys("item"), F
        for key in (side, f"{side}_value", f"{side}Value"):
            found = found.when(F.array_contains(keys, key), F.coalesce(F.col(f"c.{key}"), F.lit("")))
        return found.otherwise("")

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"c.{field}"), F.lit(""))

    return rows.select(
        "contract", "version", "owner", "dataset", "pos", name.alias("column"),
        F.coalesce(_filled(F.col("c.type")), F.lit(fixed.DEFAULT_TYPE)).alias("type"),
        flag(F.col("item"), "required").alias("required"), text("description").alias("description"),
        text("format").alias("format"), _full_pattern(F.col("c")).alias("pattern"),
        _list(F.coalesce(F.when(~F.col("c.allowed_values").isin("", "[]"), F.col("c.allowed_values")),
                         F.col("c.allowedValues"))).alias("allowed_values"),
        bound("min").alias("min_value"), bound("max").alias("max_value"),
        flag(F.col("item"), "unique").alias("unique"), flag(F.col("item"), "pii").alias("pii"), "criticality",
    )


def load_contracts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rules of every contract file below ``path`` (``.json``, ``.yaml``, ``.yml``)."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )
    suffix = F.lower(F.regexp_extract("source", r"\.([^./]+)\z", 1))
    from_json = texts.filter(suffix == "json").select("source", F.col("text").alias("json"))
    if yaml is None:
        return contract_rules(from_json, strict)
    from_yaml = yaml_as_json(texts.filter(suffix.isin("yaml", "yml")))
    return contract_rules(from_json.unionByName(from_yaml), strict)
