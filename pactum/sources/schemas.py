"""Received schemas as ``columns_meta`` rows: inferred, read, declared or catalogued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum import fixed
from pactum.functions import values
from pactum.functions.text import strip
from pactum.types import COLUMNS_META

# -- inference from text ---------------------------------------------------------------------------

_INT, _FLOAT, _BOOLEAN, _OTHER = 1, 2, 4, 8


def _kind(cell: Column, plain: Column) -> Column:
    """Narrowest kind of a cell as one bit; null for an empty cell.  White space is a value."""
    return F.when(cell == "", F.lit(None).cast("int")).when(plain.rlike(values.INT_SHAPE), _INT).when(
        plain.rlike(values.FLOAT_SHAPE), _FLOAT
    ).when(F.lower(plain).isin(fixed.INFERRED_BOOLEAN_WORDS), _BOOLEAN).when(cell.isNotNull(), _OTHER)


def infer_types(
    df: DataFrame, columns: list[str] | None = None, dataset: Column | None = None, infer_temporal: bool = False,
) -> DataFrame:
    """Type of each text column over the whole table: long, double, boolean or string.

    Each column is reduced to the set of kinds that occur in it, one ``bit_or`` per column, so a
    single pass with map-side combining answers for all columns and nothing is unpivoted.
    With ``infer_temporal`` a column of ISO dates or timestamps is typed as such.
    """
    columns = columns or df.columns
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    name = F.lit("source") if dataset is None else dataset
    staged = df.select(
        name.alias("dataset"), *[c.alias(f"c{n}") for n, c in enumerate(cells)],
        *[strip(c).alias(f"p{n}") for n, c in enumerate(cells)],
    )
    tests = {"kinds": lambda c, p: _kind(c, p)}
    if infer_temporal:
        tests["dates"] = lambda c, p: F.when(c != "", values.reads_as_date(p))
        tests["stamps"] = lambda c, p: F.when(c != "", values.reads_as_timestamp(p))
    judged = staged.select("dataset", *[
        test(F.col(f"c{n}"), F.col(f"p{n}")).alias(f"{kind}{n}") for kind, test in tests.items()
        for n in range(len(columns))
    ])
    wide = judged.groupBy("dataset").agg(*[
        (F.bit_or if kind == "kinds" else F.bool_and)(f"{kind}{n}").alias(f"{kind}{n}")
        for kind in tests for n in range(len(columns))
    ])
    rows = wide.select("dataset", F.explode(F.array(*[
        F.struct(F.lit(n).alias("pos"), F.lit(c).alias("column"), *[F.col(f"{k}{n}").alias(k) for k in tests])
        for n, c in enumerate(columns)
    ])).alias("c"))
    kinds = F.col("c.kinds")
    found = F.when(kinds == _INT, F.lit("long")).when(kinds.isin(_FLOAT, _INT | _FLOAT), F.lit("double")).when(
        kinds == _BOOLEAN, F.lit("boolean"))
    if infer_temporal:
        found = found.when(F.col("c.dates"), F.lit("date")).when(F.col("c.stamps"), F.lit("timestamp"))
    return rows.select("dataset", F.col("c.pos").alias("pos"), F.col("c.column").alias("column"),
                       found.otherwise(F.lit("string")).alias("type"), F.lit(False).alias("required"))


# -- schemas that Spark knows ------------------------------------------------------------------------


def received_type(data_type: T.DataType) -> str:
    """Name under which a typed source column is compared with a contract."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "string"


def _meta(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    return spark.createDataFrame([
        (dataset, pos, field.name, received_type(field.dataType), not field.nullable)
        for dataset, schema in schemas.items() for pos, field in enumerate(schema.fields)
    ], COLUMNS_META)


def schema_of(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Schemas of DataFrames; no data is read."""
    return _meta(spark, {name: df.schema for name, df in frames.items()})


def schema_from_parquet(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Schemas of Parquet datasets, from the footers alone."""
    return schema_of(spark, {name: spark.read.parquet(path) for name, path in paths.items()})


def schema_from_catalog(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Schemas of catalogued tables and views (``database.table`` or ``table``)."""
    return schema_of(spark, {name: spark.table(name) for name in tables})


# -- schemas declared in JSON ------------------------------------------------------------------------


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value)).isin(fixed.TRUTHY_WORDS), F.lit(False))


def flag(item: Column, field: str) -> Column:
    """A field of a JSON object as yes or no: a boolean as it is, a text by its word, a number unless it is 0, a
    list or object unless it is empty; null or absent is no."""
    value = F.from_json(item, f"{field} variant")[field]
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = F.coalesce(text.try_cast("double") != 0, F.lit(False))
    return F.coalesce(
        F.when(kind == "STRING", truthy(text)).when(kind == "BOOLEAN", text == "true").when(kind == "VOID", F.lit(False))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(value).isin("[]", "{}")).otherwise(number),
        F.lit(False))


def _declared(documents: DataFrame, source: str, text: str) -> DataFrame:
    """origin (the source column), name, items (column objects as JSON texts) and error of schema documents."""
    plain = strip(F.col(text))
    wrapped = F.when(plain.startswith("["), F.concat(F.lit('{"columns":'), plain, F.lit("}"))).otherwise(plain)
    parsed = F.from_json(wrapped, "name string, columns string")
    rows = documents.select(
        F.col(source).cast("string").alias("origin"), F.try_parse_json(plain).isNotNull().alias("readable"),
        parsed["name"].alias("name"), parsed["columns"].alias("columns"))
    items = F.filter(F.from_json("columns", "array<string>"), lambda x: strip(x).startswith("{"))
    rows = rows.withColumn("items", items)
    nameless = F.exists("items", lambda x: F.coalesce(F.from_json(x, "name string")["name"], F.lit("")) == "")
    error = (
        F.when(~F.coalesce("readable", F.lit(False)), F.lit("not a JSON document"))
        .when(F.col("columns").isNull(), F.lit("neither a list of columns nor an object with columns"))
        .when(~strip(F.col("columns")).startswith("["), F.lit("columns must be a list"))
        .when(nameless, F.lit("column name is missing"))
    )
    return rows.withColumn("error", error)


def schema_errors(documents: DataFrame, source: str, text: str) -> DataFrame:
    """Documents that declare no schema, with the reason."""
    return _declared(documents, source, text).select(F.col("origin").alias("source"), "error").filter(F.col("error").isNotNull())


def schema_from_json(documents: DataFrame, source: str, text: str, strict: bool = True) -> DataFrame:
    """Declared schemas, one JSON document per row: ``{name?, columns: [...]}`` or a bare list.

    The dataset is named by the document, else by the source column.  Items that are no objects are passed
    over.  ``strict`` stops at a document that declares no schema; otherwise such documents are left out and can
    be listed with ``schema_errors``.
    """
    rows = _declared(documents, source, text)
    stop = F.raise_error(F.concat(F.col("error"), F.lit(": "), F.coalesce("origin", F.lit("?"))))
    kept = F.when(F.col("error").isNull(), F.col("items"))
    rows = rows.withColumn("items", F.when(F.col("error").isNotNull(), stop).otherwise(kept) if strict else kept)
    columns = rows.select(
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("origin")).alias("dataset"), F.posexplode("items").alias("pos", "item"))
    parsed = columns.withColumn("c", F.from_json("item", "name string, type string"))
    return parsed.select(
        "dataset", "pos", F.col("c.name").alias("column"),
        F.coalesce(F.when(F.col("c.type") != "", F.col("c.type")), F.lit(fixed.DEFAULT_TYPE)).alias("type"),
        flag(F.col("item"), "required").alias("required"),
    )
