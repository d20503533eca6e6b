"""Data files: CSV and Parquet scans, listing, admission, row numbers, text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum import fixed


def scan_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False, schema: str | None = None) -> DataFrame:
    """CSV with a header, every column as text; short rows are padded, surplus cells dropped.

    Files are split between tasks; set ``multi_line`` only for files whose quoted cells hold line
    breaks, as such a file must be read by one task.
    """
    reader = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("enforceSchema", schema is None)
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """Row data by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return scan_csv(spark, path)
    if suffix == "parquet":
        return scan_parquet(spark, path)
    raise ValueError("row data must be CSV or Parquet")


def row_sample(df: DataFrame, row: Column, n: int = fixed.MAX_DATA_ROWS + 1) -> DataFrame:
    """The first ``n`` rows: the sampling operator.  Validation itself takes whole tables."""
    return df.orderBy(row).limit(n)


# -- row numbers --------------------------------------------------------------------------------

MAX_BLOCKS = 200_000  # block tables up to this many rows are broadcast


def _before(table: DataFrame, within: str, order: str, rows: str, name: str) -> DataFrame:
    """Add the rows of what comes earlier in `order`, inside its own `within`."""
    earlier = F.sum(rows).over(Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return table.withColumn(name, F.coalesce(earlier, F.lit(0).cast("long")))


def with_row_parquet(df: DataFrame) -> DataFrame:
    """Row number within each Parquet file, from the reader itself."""
    return df.select("*", (F.col("_metadata.row_index") + fixed.FIRST_ROW).alias("row"))


def with_row_csv(df: DataFrame, across_files: bool = False) -> DataFrame:
    """Record number of each row of a CSV scan, the first record being row 2.

    The rows of one file block keep their order within a task, so a row's number is its place in
    the block plus the sizes of the blocks before it.  Only the block table (one row per file
    split) is gathered for the running totals.  The totals come back by a join on the block: as a
    broadcast while the number of splits, known before the job runs, is within ``MAX_BLOCKS``, so
    that the data is not shuffled; as an ordinary join beyond that.  Call it on the scan itself,
    before any filter.

    Counts restart with every file; ``across_files`` goes on through the files by folder and name.  Totals are
    then summed in three levels, blocks of a file, files of a folder, folders, so that no task orders all files.
    """
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = placed.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    offsets = _before(blocks, "__file", "__block", "__rows", "__before")
    if across_files:
        folder = F.regexp_replace("__file", r"/[^/]*\z", "/")
        files = blocks.groupBy("__file").agg(F.sum("__rows").alias("__rows")).withColumn("__folder", folder)
        files = _before(files, "__folder", "__file", "__rows", "__in_folder")
        # a row for each folder, held in one sorted array
        listed = F.sort_array(F.collect_list(F.struct(F.col("__folder").alias("folder"), F.col("__rows").alias("rows"))))
        totals = files.groupBy("__folder").agg(F.sum("__rows").alias("__rows")).agg(listed.alias("all"))
        summed = F.expr(
            "aggregate(all, named_struct('sum', 0L, 'out', CAST(array() AS array<struct<folder:string,earlier:bigint>>)), "
            "(a, x) -> named_struct('sum', a.sum + x.rows, 'out', array_append(a.out, named_struct('folder', x.folder, 'earlier', a.sum)))).out")
        folders = totals.select(F.inline(summed)).select(F.col("folder").alias("__folder"), F.col("earlier").alias("__earlier"))
        files = files.join(folders, "__folder").select("__file", (F.col("__in_folder") + F.col("__earlier")).alias("__earlier"))
        offsets = offsets.join(files, "__file").withColumn("__before", F.col("__before") + F.col("__earlier"))
    offsets = offsets.select("__file", "__block", "__first", "__before")
    if len(df.inputFiles()) + df.rdd.getNumPartitions() <= MAX_BLOCKS:
        offsets = F.broadcast(offsets)
    row = F.col("__id") - F.col("__first") + F.col("__before") + fixed.FIRST_ROW
    return placed.join(offsets, ["__file", "__block"]).withColumn("row", row).drop(
        "__file", "__block", "__id", "__first", "__before"
    )


# -- listing and admission ------------------------------------------------------------------------


MAX_EMPTY_LISTING = 1_000_000  # file names looked through for empty files


def list_objects(spark: SparkSession, path: str, prefix: str = "", with_empty: bool = True) -> DataFrame:
    """Files below ``path`` whose base name starts with ``prefix``: path, size.

    The file contents are not read; only the listing columns remain in the scan.  A scan passes
    over empty files, so these are taken from the file index, which the driver holds anyway; its
    size is checked, ``with_empty=False`` leaves them out.
    """
    source = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", prefix + "*").load(path)
    )
    listed = source.select("path", F.col("length").alias("size"))
    if not with_empty:
        return listed
    names = source.inputFiles()
    if len(names) > MAX_EMPTY_LISTING:
        raise ValueError(f"more than {MAX_EMPTY_LISTING} files; list them by folder or with with_empty=False")
    indexed = spark.createDataFrame([(name,) for name in names], "path string").select(
        F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"\Afile:/+", "file:/").alias("path")
    )
    empty = indexed.join(listed, "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"))
    return listed.unionByName(empty)


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\A[a-z][a-z0-9+.-]*:(?://[^/]*)?/*", "/")


def admit_files(
    files: DataFrame, suffixes: list[str] = tuple(fixed.DATA_SUFFIXES), max_bytes: int = fixed.MAX_FILE_BYTES,
    roots: list[str] = (),
) -> DataFrame:
    """Add ``reason``: why a listed file may not be validated, null when it may."""
    path = _plain_path(F.col("path"))
    suffix = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)\z", 1))
    inside = F.lit(not roots)
    for root in roots:
        inside = inside | path.startswith(root.rstrip("/") + "/")
    climbs = path.contains("/../")
    return files.withColumn(
        "reason",
        F.when(climbs | ~inside, F.lit("outside_root"))
        .when(~suffix.isin(list(suffixes)), F.lit("bad_suffix"))
        .when(F.col("size") <= 0, F.lit("empty"))
        .when(F.col("size") > max_bytes, F.lit("too_large")),
    )


def scan_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Text documents, whole: source (file name), text."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")
    )
