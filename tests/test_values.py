"""Parsing edge cases: texts and whether they are accepted."""

import datetime

import pytest
from pyspark.sql import functions as F

from pactum.functions import formats, text, values

TEXTS = {
    "int": (["0", "-5", "+7", "007", "1_000", "123456789012345678901234567890"],
            ["12.0", "1e3", "_1", "1_", "1__0", "0x1", "", "five", "1 0"]),
    "double": (["1", "1.", ".5", "1e5", "-1E-3", "nan", "inf", "-Infinity", "1_0.5_0", "+3.5"],
               ["1d", "1f", "0x1p3", "e5", "1e", "1_", "--1", "1,5", "."]),
    "decimal": (["1", "1.", ".5", "1e5", "NaN", "-inf", "sNaN", "1_000.5", "_1_"], ["1d", "e5", ".", "abc", "1e1.5"]),
    "boolean": (["true", "FALSE", "1", "0", "Yes", "no"], ["t", "y", "2", "on", "tru"]),
    "date": (["1990-01-02", "2024-02-29"],
             ["1990-1-2", "1990", "1990-01", "1990-02-30", "0000-01-01", "1990-01-02 00:00:00", "01/02/1990"]),
    "timestamp": (["1990-01-02", "1990-01-02T10", "1990-01-02 10:30", "1990-01-02T10:30:05.123456Z",
                   "1990-01-02T10:30:05,5+02:00", "1990-01-02x10:30"],
                  ["1990-02-30T10:00", "1990-01-02T24:00", "1990-01-02T10:60", "1990-01-02T", "1990-01", "10:30"]),
}


@pytest.mark.parametrize("kind", TEXTS)
def test_type_texts(spark, kind):
    good, bad = TEXTS[kind]
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, ok boolean")
    wrong = df.filter(values.reads_as(F.col("t"), kind) != F.col("ok")).collect()
    assert wrong == []


def test_unknown_types_accept_everything(spark):
    df = spark.createDataFrame([("anything",)], "t string")
    assert df.filter(values.reads_as(F.col("t"), "smallint")).count() == 1


@pytest.mark.parametrize("fmt, good, bad", [
    ("%Y-%m-%d", ["1990-01-02", "1990-1-2", "1990-01- 2"], ["1990-02-30", "90-01-02", "0000-01-01", "1990-01-02 "]),
    ("%d/%m/%Y", ["31/12/1999", "1/2/1990"], ["12/31/1999", "1990-01-02"]),
    ("%Y%m%d", ["19900102", "1990112"], ["199001", "19901332"]),
    ("%Y-%m-%d %H:%M:%S", ["1990-01-02 1:2:3", "1990-01-02  10:20:30"], ["1990-01-02 25:00:00", "1990-01-02"]),
    ("%H.%M", ["10.30"], ["10:30", "1030"]),
])
def test_formats(spark, fmt, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, ok boolean")
    assert df.filter(formats.fits_format(F.col("t"), fmt) != F.col("ok")).collect() == []
    for t in good:  # the same texts fit by Python's own reading
        datetime.datetime.strptime(t, fmt)


def test_unsupported_directive_is_refused():
    with pytest.raises(ValueError):
        formats.format_regex("%y-%j")


def test_spark_date_pattern():
    assert formats.spark_date_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


def test_pattern_covers_the_whole_value(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("xabc",), ("ÀB1",)], "t string")
    assert [r["t"] for r in df.filter(formats.matches_pattern(F.col("t"), "^abc$")).collect()] == ["abc"]
    assert [r["t"] for r in df.filter(formats.matches_pattern(F.col("t"), r"(?P<a>\w)\w\d")).collect()] == ["ÀB1"]


def test_strip_blank_and_redact(spark):
    df = spark.createDataFrame([(None,), ("\t   ",), (" a ",), ("@x",), ("bob@a@b",), ("é@q",), ("y" * 81,),
                                ("y" * 80,)], "t string")
    rows = df.select(text.is_blank(F.col("t")).alias("b"), text.redact(text.strip(F.col("t"))).alias("r")).collect()
    assert [r["b"] for r in rows] == [True, True] + [False] * 6
    assert [r["r"] for r in rows[2:]] == ["a", "***@x", "b***@a@b", "é***@q", "y" * 77 + "...", "y" * 80]


@pytest.mark.parametrize("value, bound, side, outside", [
    ("0.1", "0.1", "min", False), ("0.09999999999999999999", "0.1", "min", False), ("1e30", "1e29", "max", True),
    ("0.10000000000000001", "0.1", "max", True), ("inf", "5", "max", True), ("-inf", "5", "min", True),
    ("1_000", "999", "max", True), ("123456789012345678901234567890", "1", "max", True), ("5", "abc", "max", False),
])
def test_text_bounds(spark, value, bound, side, outside):
    df = spark.createDataFrame([(value,)], "t string")
    test = values.text_outside(F.col("t"), values.text_number(F.col("t")), bound, side)
    assert df.select(test.alias("x")).first()["x"] is outside


@pytest.mark.parametrize("kind, value, bound, side, outside", [
    ("int", 5, "5.5", "min", True), ("int", 6, "5.5", "min", False), ("bigint", 5, "5.5", "max", False),
    ("bigint", 6, "5.5", "max", True), ("double", 0.1, "0.1", "min", False),
    ("double", 0.1, "0.1000000000000000055", "min", True), ("bigint", 1, "inf", "min", True),
    ("bigint", 1, "1e40", "max", False), ("bigint", 1, "1e40", "min", True), ("decimal(10,2)", 5, "4.999", "max", True),
])
def test_number_bounds(spark, kind, value, bound, side, outside):
    df = spark.createDataFrame([(value,)], "v double" if kind == "double" else "v int").select(F.col("v").cast(kind))
    test = values.number_outside(F.col("v"), df.schema["v"].dataType, bound, side)
    assert df.select(test.alias("x")).first()["x"] is outside
