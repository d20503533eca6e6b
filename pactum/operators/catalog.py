"""The check catalogue: what is said about every check, and what is done about it.

Every text is a template over the fields of an issue.  It becomes one SQL expression over columns, or over the
elements of an array of issues (``of`` names the element), so reports need no lookup join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import fixed

# what a template may name; a null field prints as nothing
_FIELDS = {
    "column": "coalesce({of}`column`, '')",
    "expected": "coalesce({of}expected, '')",
    "actual": "coalesce({of}actual, '')",
    "message": "coalesce({of}message, '')",
    "bound": "regexp_replace(coalesce({of}expected, ''), '^[<>]= ', '')",
    "domain": "coalesce(array_join({of}expected_values, ', '), '')",
    "number": "regexp_extract(coalesce({of}actual, ''), '^([0-9]+)', 1)",
    "cells": "{of}cells",
}


def _sql(template: str, of: str) -> str:
    parts = [
        _FIELDS[part[1:-1]].replace("{of}", of) if part.startswith("{") else "'" + part.replace("\\", "\\\\").replace("'", "\\'") + "'"
        for part in re.split(r"(\{\w+\})", template) if part
    ]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def by_check_sql(templates: dict[str, str], of: str = "", otherwise: str | None = None) -> str:
    """Text by check name; null (or ``otherwise``) for a check without one."""
    prefix = f"{of}." if of else ""
    cases = " ".join(f"WHEN '{check}' THEN {_sql(template, prefix)}" for check, template in templates.items())
    last = f" ELSE {_sql(otherwise, prefix)}" if otherwise else ""
    return f"CASE {prefix}`check` {cases}{last} END"


def by_check(templates: dict[str, str], otherwise: str | None = None) -> Column:
    return F.expr(by_check_sql(templates, otherwise=otherwise))


MESSAGES = {
    fixed.RENAMED: "not delivered under its name; another column resembles it",
    fixed.MISSING: "not delivered",
    fixed.PROMOTION: "delivered in a wider type that holds all agreed values",
    fixed.TYPE_CHANGE: "delivered in another type",
    fixed.EXTRA: "delivered without being agreed",
    fixed.REQUIRED: "{number} cells empty that must be filled",
    fixed.ALLOWED: "value outside the agreed list",
    fixed.PATTERN: "value outside the agreed pattern",
    fixed.FORMAT: "date or time in another notation",
    fixed.VALUE_TYPE: "value unreadable in the agreed type",
    fixed.MINIMUM: "number under the agreed range",
    fixed.MAXIMUM: "number over the agreed range",
    fixed.UNIQUE: "{number} cells share a value that only one may have",
    fixed.ISSUE_LIMIT: "list of issues cut at its limit",
}

ISSUE_IMPACTS = {
    fixed.RENAMED: "queries by the agreed name find nothing",
    fixed.MISSING: "whatever reads the column comes to a halt or runs without it",
    fixed.PROMOTION: "none today; agreement and data should be brought in line",
    fixed.TYPE_CHANGE: "implicit conversion on write, or a refused write",
    fixed.EXTRA: "an undocumented field that someone will come to rely on",
    fixed.REQUIRED: "keys without a match and totals that are too low",
    fixed.ALLOWED: "groups that no rule or filter knows",
    fixed.PATTERN: "lookups by this value miss",
    fixed.FORMAT: "dates read as null, or as another day",
    fixed.VALUE_TYPE: "the cell is lost when it is converted",
    fixed.MINIMUM: "sums and averages pulled down",
    fixed.MAXIMUM: "sums and averages pulled up",
    fixed.UNIQUE: "joins by the column multiply rows",
    fixed.ISSUE_LIMIT: "what comes after the limit is unknown",
}


def describe_issues(issues: DataFrame, *also: str) -> DataFrame:
    """Add message and impact, keep the columns of ``types.ISSUES`` (and others named)."""
    return issues.select(
        "dataset", "contract", "ord", "severity", "check", "column", by_check(MESSAGES).alias("message"), "expected",
        "expected_values", "actual", "row", by_check(ISSUE_IMPACTS).alias("impact"), *also,
    )


# -- corrections -------------------------------------------------------------------------------

SUGGESTIONS = {
    fixed.RENAMED: "give `{actual}` its agreed name `{expected}` again",
    fixed.MISSING: "send `{column}` ({expected}), or agree that it may be left out",
    fixed.PROMOTION: "agree on {actual} for `{column}` in place of {expected}",
    fixed.TYPE_CHANGE: "turn `{column}` from {actual} into {expected} before it is sent",
    fixed.EXTRA: "agree on `{column}` ({actual}), or stop sending it",
    fixed.REQUIRED: "fill `{column}`, or hold back the rows without it",
    fixed.ALLOWED: "bring `{column}` to one of: {domain}",
    fixed.PATTERN: "bring `{column}` into the form {expected}",
    fixed.FORMAT: "write `{column}` as {expected}",
    fixed.VALUE_TYPE: "send only {expected} in `{column}`",
    fixed.MINIMUM: "hold back rows with `{column}` under {bound}, or mend their source",
    fixed.MAXIMUM: "hold back rows with `{column}` over {bound}, or mend their source",
    fixed.UNIQUE: "send each `{column}` once",
}
#: A rename is addressed to the received column, everything else to the contract column.
TARGETS, OTHER_TARGET = {fixed.RENAMED: "{actual}"}, "{column}"


def correction_action() -> Column:
    return by_check(fixed.ACTIONS)


def correction_target() -> Column:
    return by_check(TARGETS, otherwise=OTHER_TARGET)


def correction_text() -> Column:
    return by_check(SUGGESTIONS)


# -- explanations ------------------------------------------------------------------------------

PROBLEMS = {
    fixed.RENAMED: "`{column}` is not there, `{actual}` may be its new name",
    fixed.MISSING: "`{column}` is not there",
    fixed.EXTRA: "`{column}` was never agreed",
    fixed.TYPE_CHANGE: "`{column}` comes as {actual}, agreed is {expected}",
    fixed.REQUIRED: "`{column}`: {cells} cells empty",
    fixed.FORMAT: "`{column}`: {cells} cells not in the notation {expected} (first: {actual})",
    fixed.VALUE_TYPE: "`{column}`: {cells} cells that are no {expected} (first: {actual})",
    fixed.PATTERN: "`{column}`: {cells} cells outside the pattern",
    fixed.MINIMUM: "`{column}`: {cells} cells under {bound}",
    fixed.MAXIMUM: "`{column}`: {cells} cells over {bound}",
    fixed.UNIQUE: "`{column}`: {cells} cells share a value",
}
OTHER_PROBLEM = "`{column}`: {message}"
CAUSES = {
    fixed.RENAMED: "schema: `{expected}` goes by `{actual}` at its source",
    fixed.FORMAT: "notation: the source of `{column}` follows another convention",
    fixed.MINIMUM: "range: low values of `{column}` pass the source unchecked",
    fixed.REQUIRED: "completeness: rows leave the source before `{column}` is known",
    fixed.TYPE_CHANGE: "schema: source and agreement differ in the type of `{column}`",
}
PLAN = {
    fixed.RENAMED: "map `{actual}` to `{expected}`",
    fixed.MISSING: "obtain `{column}`, or make it optional",
    fixed.TYPE_CHANGE: "convert `{column}` to {expected}",
    fixed.REQUIRED: "set rows without `{column}` aside",
    fixed.FORMAT: "rewrite `{column}` as {expected}",
    fixed.VALUE_TYPE: "cleanse `{column}` down to {expected}",
    fixed.MINIMUM: "set rows with `{column}` under {bound} aside",
    fixed.MAXIMUM: "set rows with `{column}` over {bound} aside",
    fixed.EXTRA: "decide on `{column}`: agree or drop",
}

# (checks that trigger it, column names that trigger it, text), in report order
IMPACT_RULES = [
    ([fixed.RENAMED], [], "readers of an agreed name come away empty"),
    ([fixed.MISSING], [], "steps that need an absent column cannot run"),
    ([fixed.TYPE_CHANGE], [], "writes convert silently or are refused"),
    ([fixed.FORMAT], [], "days and months may trade places"),
    ([fixed.VALUE_TYPE], [], "cells get lost in conversion"),
    ([fixed.MINIMUM, fixed.MAXIMUM], [], "figures are off by values out of range"),
    ([fixed.REQUIRED], [], "joins and totals miss the rows with empty cells"),
    ([fixed.MISSING, fixed.RENAMED, fixed.TYPE_CHANGE, fixed.VALUE_TYPE, fixed.FORMAT], [], "the load itself may break off"),
    ([], ["customer_id"], "rows may end up with the wrong customer"),
    ([], ["amount"], "money totals are not to be relied on"),
    ([], ["email", "mail"], "address protection may look at the wrong field"),
]

# fixes that can be carried out on the data
FIX_OPERATIONS = {
    fixed.RENAMED: "rename", fixed.TYPE_CHANGE: "cast", fixed.REQUIRED: "quarantine_blank",
    fixed.FORMAT: "normalize_date", fixed.VALUE_TYPE: "clean_cast", fixed.MINIMUM: "reject_below_min",
    fixed.EXTRA: "drop",
}
FIX_TITLES = {
    fixed.RENAMED: "{actual} -> {expected}",
    fixed.TYPE_CHANGE: "{column} as {expected}",
    fixed.REQUIRED: "{column} filled",
    fixed.FORMAT: "{column} in one notation",
    fixed.VALUE_TYPE: "{column} readable",
    fixed.MINIMUM: "{column} within range",
    fixed.EXTRA: "without {column}",
}
