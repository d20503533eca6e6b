"""Text helpers shared by every check: strip, blank test, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum import fixed


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(value, F.lit(fixed.WHITESPACE))


def is_blank(value: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return value.isNull() | (strip(value) == "")


def redact(value: Column) -> Column:
    """Hide the local part of anything holding an ``@``; shorten other long values."""
    at = F.instr(value, "@")
    masked = F.concat(
        F.when(at > 1, F.substring(value, 1, 1)).otherwise(F.lit("")),
        F.lit("***@"),
        F.substring(value, at + 1, F.length(value)),
    )
    short = F.concat(F.substring(value, 1, fixed.REDACT_KEEP), F.lit("..."))
    return F.when(at > 0, masked).when(F.length(value) > fixed.REDACT_LENGTH, short).otherwise(value)


def first_word_number(value: Column, fallback: Column) -> Column:
    """Leading whole number of a text such as ``4 empty values``, else the fallback."""
    word = F.split(strip(value), " ", 2)[0]
    return F.when(word.rlike(r"\A\d+\z"), word).otherwise(fallback.cast("string"))


def bound_text(value: Column) -> Column:
    """Bound without its comparison sign."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\A(?:>= |<= )", "")
