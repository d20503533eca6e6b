"""Can a text be read as a type, and does it lie within bounds?  Built-in expressions only.

The shapes are given as regular expressions rather than casts because Spark's casts are both
wider (``1d``, ``1990``, ``t``) and narrower (``1_000``, integers past 64 bits) than the rules.
Digits are the ASCII digits; dates and timestamps are read in the extended ISO form.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum import fixed

# -- fixed values: accepted shapes -----------------------------------------------------------
INT_SHAPE = r"\A[+-]?\d+(?:_\d+)*\z"
FLOAT_SHAPE = (
    r"(?i)\A[+-]?(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?"
    r"|inf|infinity|nan)\z"
)
DECIMAL_SHAPE = r"(?i)\A[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|inf|infinity|s?nan\d*)\z"
DATE_SHAPE = r"\A(?!0000)\d{4}-\d{2}-\d{2}\z"
TIMESTAMP_SHAPE = (
    r"(?s)\A(?!0000)\d{4}-\d{2}-\d{2}"
    r"(?:.(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?)?\z"
)
NAN_SHAPE = r"(?i)\A[+-]?s?nan\d*\z"

EXACT = "decimal(38,18)"


def reads_as_int(text: Column) -> Column:
    return text.rlike(INT_SHAPE)


def reads_as_float(text: Column) -> Column:
    return text.rlike(FLOAT_SHAPE)


def reads_as_decimal(text: Column) -> Column:
    return plain_digits(text).rlike(DECIMAL_SHAPE)


def reads_as_boolean(text: Column) -> Column:
    return F.lower(text).isin(fixed.BOOLEAN_WORDS)


def reads_as_date(text: Column) -> Column:
    return text.rlike(DATE_SHAPE) & text.try_cast("date").isNotNull()


def reads_as_timestamp(text: Column) -> Column:
    return text.rlike(TIMESTAMP_SHAPE) & F.substring(text, 1, 10).try_cast("date").isNotNull()


READERS = {
    "int": reads_as_int,
    "long": reads_as_int,
    "float": reads_as_float,
    "double": reads_as_float,
    "decimal": reads_as_decimal,
    "boolean": reads_as_boolean,
    "date": reads_as_date,
    "timestamp": reads_as_timestamp,
}


def reads_as(text: Column, normal_type: str) -> Column:
    """True when the text can be read as the type; unknown types accept everything."""
    reader = READERS.get(normal_type)
    return reader(text) if reader else F.lit(True)


# -- bounds ------------------------------------------------------------------------------------


def parse_bound(bound: str) -> Decimal | None:
    """A bound that is not a number is ignored, so is NaN."""
    try:
        number = Decimal(bound)
    except InvalidOperation:
        return None
    return None if number.is_nan() else number


def _fits_exact(number: Decimal) -> bool:
    if not number.is_finite():
        return False
    return abs(number) < Decimal(10) ** 20 and number == round(number, 18)


def _compare(number: Column, bound: Column, side: str) -> Column:
    return number < bound if side == "min" else number > bound


def plain_digits(text: Column) -> Column:
    """The text without the underscores that may separate digits; most texts have none."""
    return F.when(text.contains("_"), F.translate(text, "_", "")).otherwise(text)


def text_number(text: Column) -> Column:
    """The number written in a text, as a double; null when there is none."""
    return plain_digits(text).try_cast("double")


def text_outside(text: Column, number: Column, bound: str, side: str) -> Column:
    """Is the number written in ``text`` below (side ``min``) or above (``max``) the bound?

    ``number`` is the text's ``text_number``.  Rounding to double keeps order, so doubles decide
    unless they are equal; only then are both compared as decimals of 38 digits.
    """
    limit = parse_bound(bound)
    if limit is None:
        return F.lit(False)
    double = F.lit(float(limit))
    beyond = _compare(number, double, side)
    if not _fits_exact(limit):
        return F.coalesce(beyond, F.lit(False))
    exact = _compare(plain_digits(text).try_cast(EXACT), F.lit(limit).cast(EXACT), side)
    return F.when(number.isNull(), F.lit(False)).when(number == double, F.coalesce(exact, F.lit(False))).otherwise(beyond)


def text_is_nan(text: Column, number: Column) -> Column:
    return F.when(number.isNotNull(), F.isnan(number)).otherwise(text.rlike(NAN_SHAPE))


def number_outside(value: Column, data_type: T.DataType, bound: str, side: str) -> Column:
    """The same test on a column that is numeric already, without going through text."""
    number = parse_bound(bound)
    if number is None:
        return F.lit(False)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        limit = float(number)
        value = value.cast("double")
        # a double equals the bound's double but not the bound itself
        shortest = Decimal(repr(limit)) if number.is_finite() else number
        tie = (shortest < number) if side == "min" else (shortest > number)
        strict = _compare(value, F.lit(limit), side)
        return (strict | (value == limit)) if tie else strict
    if not number.is_finite():
        return F.lit(number > 0 if side == "min" else number < 0)
    if isinstance(data_type, T.DecimalType):
        if not _fits_exact(number):
            return _compare(value.cast("double"), F.lit(float(number)), side)
        return _compare(value, F.lit(number).cast(EXACT), side)
    # whole numbers: move the bound to the nearest whole number on its inner side
    whole = int(number.to_integral_value(rounding="ROUND_CEILING" if side == "min" else "ROUND_FLOOR"))
    if not -(2**63) <= whole < 2**63:
        return F.lit(whole > 0 if side == "min" else whole < 0)
    return _compare(value, F.lit(whole), side)
