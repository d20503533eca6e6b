"""Date formats and regular expressions written for Python, translated for Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: what each date directive matches, and its Spark pattern letters -----------
DIRECTIVES = {
    "Y": (r"(?!0000)\d\d\d\d", "yyyy"),  # years start at 1
    "m": (r"1[0-2]|0[1-9]|[1-9]", "MM"),
    "d": (r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]", "dd"),
    "H": (r"2[0-3]|[01]\d|\d", "HH"),
    "M": (r"[0-5]\d|\d", "mm"),
    "S": (r"[0-5]\d|\d", "ss"),
}
DEFAULTS = {"Y": "1900", "m": "01", "d": "01", "H": "00", "M": "00", "S": "00"}

_JAVA_META = set("\\^$.|?*+()[]{}")


def _tokens(fmt: str):
    at = 0
    while at < len(fmt):
        if fmt[at] == "%":
            letter = fmt[at + 1: at + 2]
            if letter == "%":
                yield "literal", "%"
            elif letter in DIRECTIVES:
                yield "directive", letter
            else:
                raise ValueError(f"date directive %{letter} in {fmt!r} is not supported")
            at += 2
        else:
            yield "literal", fmt[at]
            at += 1


def format_regex(fmt: str) -> tuple[str, list[str]]:
    """Regular expression of a date format and the directives in group order.

    The atomic group keeps the first match only, as the format's own parser does, so that
    ``%Y%m%d`` reads ``1990112`` one way and never backtracks into another.
    """
    parts, order = [], []
    for kind, text in _tokens(fmt):
        if kind == "directive":
            if text in order:
                raise ValueError(f"date directive %{text} occurs twice in {fmt!r}")
            order.append(text)
            parts.append(f"({DIRECTIVES[text][0]})")
        elif text.isspace():
            if not parts or parts[-1] != r"\s+":
                parts.append(r"\s+")
        else:
            parts.append("\\" + text if text in _JAVA_META else text)
    return r"(?i)\A(?>" + "".join(parts) + r")\z", order


def parse_format(value: Column, fmt: str) -> Column:
    """Date (or timestamp, for formats with a time) read by a date format; null when it does not
    fit."""
    regex, order = format_regex(fmt)

    def group(letter: str) -> str:
        return f"${order.index(letter) + 1}" if letter in order else DEFAULTS[letter]

    text = "{}-{}-{}".format(group("Y"), group("m"), group("d"))
    target = "date"
    if {"H", "M", "S"} & set(order):
        text, target = text + " {}:{}:{}".format(group("H"), group("M"), group("S")), "timestamp_ntz"
    # a value in year-month-day order is what the cast reads already
    plain = value if fmt == "%Y-%m-%d" else F.regexp_replace(value, regex, text)
    if "d" in order:
        plain = F.replace(plain, F.lit("- "), F.lit("-"))  # a day may be padded with a space
    return F.when(value.rlike(regex), plain.try_cast(target))


def fits_format(value: Column, fmt: str) -> Column:
    return parse_format(value, fmt).isNotNull()


def spark_date_pattern(fmt: str) -> str:
    """Spark date pattern for a date format, for ``date_format`` and ``try_to_date``."""
    out = ""
    for kind, text in _tokens(fmt):
        if kind == "directive":
            out += DIRECTIVES[text][1]
        elif text == "'":
            out += "''"
        else:
            out += f"'{text}'" if text.isalpha() else text
    return out


def full_match(pattern: str) -> str:
    """Python pattern as a Java pattern that must cover the whole value.

    ``(?d)`` makes the newline the only line end; ``(?U)`` lets the letter classes see Unicode.
    """
    re.compile(pattern)
    java = pattern.replace("(?P<", "(?<")
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    flags = "dU" if re.search(r"\\[dDwWsSbB]", java) else "d"
    return rf"(?{flags})\A(?:{java})\z"


def matches_pattern(value: Column, pattern: str) -> Column:
    return value.rlike(full_match(pattern))
