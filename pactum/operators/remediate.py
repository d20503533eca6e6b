"""Corrections carried out on the data: rename, cast, normalise, split off bad rows, mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum import fixed
from pactum.functions import formats, pii, text, values
from pactum.operators.cell_checks import Cell, breaks_min, cell_check, locate_cells, stage_cells
from pactum.types import Contract, Rule, normal_type

_SPARK_TYPES = {
    "string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz",
}


def spark_type(contract_type: str) -> str | None:
    """Spark type of a contract type, None for names without one."""
    normal = normal_type(contract_type)
    if normal == "decimal":
        inner = contract_type.partition("(")[2].rstrip(") ").strip()
        return f"decimal({inner})" if inner else values.EXACT
    return _SPARK_TYPES.get(normal)


def clean_cast(value: Column, data_type: T.DataType, contract_type: str) -> Column:
    """Value in the contract type; null where it cannot be read as that type, never an error."""
    target = spark_type(contract_type)
    if target is None:
        return value
    if not isinstance(data_type, T.StringType):
        return value.try_cast(target)
    normal = normal_type(contract_type)
    plain = text.strip(value)
    readable = values.reads_as(plain, normal)
    if normal in fixed.NUMERIC_TYPES:
        plain = F.translate(plain, "_", "")
    return F.when(readable, plain.try_cast(target))


def _field(df: DataFrame, column: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name.lower() == column.lower())


def fix_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Give received columns (keys) their contract names (values)."""
    return df.withColumnsRenamed(names)


def fix_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to their contract types in one projection."""
    return df.withColumns({
        column: clean_cast(F.col(column), _field(df, column).dataType, wanted) for column, wanted in types.items()
    })


def fix_value_type(df: DataFrame, column: str, contract_type: str) -> DataFrame:
    """Values that cannot be read as the type become null."""
    return fix_cast(df, {column: contract_type})


def fix_date_format(df: DataFrame, column: str, fmt: str, also: list[str] = (), contract_type: str = "date") -> DataFrame:
    """Read dates written in the contract format or one of the other formats given."""
    plain = text.strip(F.col(column))
    parsed = F.coalesce(*[formats.parse_format(plain, f) for f in [fmt, *also]])
    return df.withColumn(column, parsed.cast(spark_type(contract_type)))


def drop_extra(df: DataFrame, contract: Contract) -> DataFrame:
    """Keep the contract's columns only, in the received order."""
    wanted = {rule.column.lower() for rule in contract.rules}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() in wanted])


# -- split into valid and rejected rows ----------------------------------------------------------


def _split(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) on one predicate; an unknown outcome stays with the valid rows."""
    bad = F.coalesce(bad, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def blank_required(df: DataFrame, columns: list[str]) -> Column:
    tests = [Cell(0, Rule(c), c, _field(df, c).dataType).blank for c in columns]
    return reduce(lambda a, b: a | b, tests)


def quarantine_required(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return _split(df, blank_required(df, columns))


def below_min(df: DataFrame, column: str, bound: str) -> Column:
    field = _field(df, column)
    cell = Cell(0, Rule(column, "double", min_value=bound), field.name, field.dataType)
    broken = breaks_min(cell)
    if broken is None:
        return F.lit(False)
    # a text that is no number is not below anything
    return values.reads_as_float(cell.text) & broken if cell.is_text else broken


def reject_below_min(df: DataFrame, column: str, bound: str) -> tuple[DataFrame, DataFrame]:
    return _split(df, below_min(df, column, bound))


def with_reasons(df: DataFrame, contract: Contract) -> DataFrame:
    """Add ``reasons``: ``column:check`` of every bad cell, empty for a valid row."""
    staged, cells = stage_cells(df, locate_cells(df, contract))
    marks = []
    for cell in cells:
        check = cell_check(cell)
        if check is not None:
            marks.append(F.concat(F.lit(f"{cell.rule.column}:"), check))
    # joining skips the nulls of good cells; the separator is a control character
    joined = F.concat_ws("\u0001", *marks) if marks else F.lit("")
    # The one-element explode keeps later filters on the reasons above this point; pushed below
    # it they would repeat every check inside the filter.
    judged = staged.withColumn("__joined", F.explode(F.array(joined)))
    reasons = F.when(F.col("__joined") == "", F.array().cast("array<string>")).otherwise(
        F.split("__joined", "\u0001"))
    return judged.withColumn("reasons", reasons).select(*[f"`{c}`" for c in df.columns], "reasons")


def quarantine_split(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons) under all rules of the contract."""
    marked = with_reasons(df, contract)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def write_split(df: DataFrame, contract: Contract, path: str, mode: str = "overwrite") -> None:
    """Write valid and quarantined rows in a single pass, as partitions of one folder."""
    verdict = F.when(F.size("reasons") == 0, F.lit("valid")).otherwise(F.lit("quarantined"))
    with_reasons(df, contract).withColumn("verdict", verdict).write.mode(mode).partitionBy("verdict").parquet(path)


# -- plan --------------------------------------------------------------------------------------

_PLAN_ORDER = ["rename", "cast", "clean_cast", "normalize_date", "drop"]


def apply_plan(df: DataFrame, contract: Contract, plan: DataFrame, also_formats: dict[str, list[str]] | None = None,
               limit: int = 10 * fixed.MAX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Carry out one dataset's remediation plan; returns (valid, rejected).

    Rejecting steps look at the received text, so they come before casts.  The plan has at most a
    few lines per column; its size is checked before it is brought to the driver.
    """
    steps = plan.orderBy("ord").limit(limit + 1).collect()
    if len(steps) > limit:
        raise ValueError(f"more than {limit} steps in one remediation plan")
    renames = {s["actual"]: s["expected"] for s in steps if s["operation"] == "rename"}
    df = fix_rename(df, renames)
    rejects = [blank_required(df, [s["column"]]) for s in steps if s["operation"] == "quarantine_blank"]
    rejects += [
        below_min(df, s["column"], s["expected"].removeprefix(">= "))
        for s in steps if s["operation"] == "reject_below_min"
    ]
    valid, rejected = df, df.limit(0)
    if rejects:
        valid, rejected = _split(df, reduce(lambda a, b: a | b, rejects))
    rules = {r.column.lower(): r for r in contract.rules}
    for step in sorted(
        (s for s in steps if s["operation"] in _PLAN_ORDER[1:]), key=lambda s: _PLAN_ORDER.index(s["operation"])
    ):
        column = step["column"]
        rule = rules.get(column.lower())
        if step["operation"] == "drop":
            valid = valid.drop(column)
        elif isinstance(_field(valid, column).dataType, T.StringType):
            if rule is not None and rule.format and rule.normal in fixed.TEMPORAL_TYPES:
                valid = fix_date_format(valid, column, rule.format, (also_formats or {}).get(column, []), rule.type)
            else:
                valid = fix_cast(valid, {column: step["expected"]})
        elif step["operation"] == "cast":
            valid = fix_cast(valid, {column: step["expected"]})
    return valid, rejected


# -- personal data -------------------------------------------------------------------------------


def mask_pii(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace e-mail addresses, social security and phone numbers in text columns."""
    return df.withColumns({c: pii.mask(F.col(c)) for c in columns})


def flagged_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Received columns that the contract flags as personal data."""
    flagged = {r.column.lower() for r in contract.rules if r.pii}
    return [c for c in df.columns if c.lower() in flagged]


def mask_flagged(df: DataFrame, contract: Contract) -> DataFrame:
    """Mask the columns the contract flags as personal data, as texts: known kinds by their word, and any
    other value as a whole."""
    return df.withColumns({c: pii.mask_flagged(F.col(f"`{c}`").cast("string")) for c in flagged_columns(df, contract)})


def drop_pii(df: DataFrame, contract: Contract) -> DataFrame:
    """Drop the columns the contract flags as personal data."""
    return df.drop(*flagged_columns(df, contract))
