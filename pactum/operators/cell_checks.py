"""Contract rules compiled into one ``Column`` per contract column.

Each expression names the first check a cell fails, or is null.  A text column is tested as
stripped text.  A column that already has a type is tested in that type wherever the outcome is
the same as for its text, so numbers are never printed only to be parsed again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum import fixed
from pactum.functions import formats, text, values
from pactum.types import Contract, Rule

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_STAMPS = (T.TimestampType, T.TimestampNTZType)


def _source(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Cell:
    """One contract column found in the data.

    ``text_as`` and ``number_as`` name columns that hold the stripped text and the number written
    in it, when an earlier projection has worked them out (see ``stage_cells``).
    """

    pos: int
    rule: Rule
    source: str
    data_type: T.DataType
    text_as: str | None = None
    number_as: str | None = None

    @property
    def raw(self) -> Column:
        return _source(self.source)

    @property
    def is_text(self) -> bool:
        return isinstance(self.data_type, T.StringType)

    @property
    def text(self) -> Column:
        """Stripped text of the cell; other types never print edge space."""
        if self.text_as:
            return F.col(self.text_as)
        return text.strip(self.raw) if self.is_text else self.raw.cast("string")

    @property
    def number(self) -> Column:
        return F.col(self.number_as) if self.number_as else values.text_number(self.text)

    @property
    def blank(self) -> Column:
        return self.text.isNull() | (self.text == "") if self.is_text else self.raw.isNull()


def stage_cells(df: DataFrame, cells: list[Cell]) -> tuple[DataFrame, list[Cell]]:
    """Work out stripped texts, and numbers where bounds need them, once per column.

    Columns shared by several contracts are staged once.
    """
    texts = {c.source: f"__text_{c.source}" for c in cells if c.is_text}
    numbers = {c.source: f"__number_{c.source}" for c in cells if c.is_text and _has_bound(c.rule)}
    if texts:
        df = df.withColumns({name: text.strip(_source(source)) for source, name in texts.items()})
    if numbers:
        df = df.withColumns({name: values.text_number(_source(texts[s])) for s, name in numbers.items()})
    return df, [
        replace(
            c, text_as=f"`{texts[c.source]}`" if c.is_text else None,
            number_as=f"`{numbers[c.source]}`" if c.is_text and c.source in numbers else None,
        )
        for c in cells
    ]


def locate_cells(df: DataFrame, contract: Contract) -> list[Cell]:
    """Contract columns present in the data, matched without case; absent ones are skipped."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    return [
        Cell(pos, rule, fields[rule.column.lower()].name, fields[rule.column.lower()].dataType)
        for pos, rule in enumerate(contract.rules)
        if rule.column.lower() in fields
    ]


# -- single rules: True where a non-blank cell breaks the rule --------------------------------


def breaks_allowed(cell: Cell) -> Column | None:
    if not cell.rule.allowed_values:
        return None
    return ~cell.text.isin(list(cell.rule.allowed_values))


def breaks_pattern(cell: Cell) -> Column | None:
    if not cell.rule.pattern:
        return None
    return ~formats.matches_pattern(cell.text, cell.rule.pattern)


def has_format(rule: Rule) -> bool:
    return bool(rule.format) and rule.normal in fixed.TEMPORAL_TYPES


def breaks_format(cell: Cell) -> Column | None:
    if not has_format(cell.rule):
        return None
    return ~formats.fits_format(cell.text, cell.rule.format)


def _has_bound(rule: Rule) -> bool:
    return rule.normal in fixed.NUMERIC_TYPES and any(
        bound and values.parse_bound(bound) is not None for bound in (rule.min_value, rule.max_value)
    )


def breaks_type(cell: Cell) -> Column | None:
    wanted, kind = cell.rule.normal, cell.data_type
    nan_fails = _has_bound(cell.rule)
    if wanted not in values.READERS:
        return None
    if cell.is_text:
        failed = ~values.reads_as(cell.text, wanted)
        return failed | values.text_is_nan(cell.text, cell.number) if nan_fails else failed
    always, never = F.lit(True), None
    if wanted in fixed.INTEGER_TYPES:
        if isinstance(kind, _WHOLE) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
            return never
        return always if isinstance(kind, (*_FLOATING, T.DecimalType, T.BooleanType, T.DateType, *_STAMPS)) else (
            ~values.reads_as(cell.text, wanted))
    if wanted in (*fixed.FLOATING_TYPES, "decimal"):
        if isinstance(kind, _FLOATING):
            return F.isnan(cell.raw) if nan_fails else never
        if isinstance(kind, (*_WHOLE, T.DecimalType)):
            return never
        return always if isinstance(kind, (T.BooleanType, T.DateType, *_STAMPS)) else (
            ~values.reads_as(cell.text, wanted))
    if wanted == "boolean":
        if isinstance(kind, T.BooleanType):
            return never
        if isinstance(kind, _WHOLE):
            return ~cell.raw.isin(0, 1)
        return always if isinstance(kind, (*_FLOATING, T.DateType, *_STAMPS)) else (
            ~values.reads_as(cell.text, wanted))
    if wanted == "date":
        if isinstance(kind, T.DateType):
            return never
        return always if isinstance(kind, (*_WHOLE, *_FLOATING, T.DecimalType, T.BooleanType, *_STAMPS)) else (
            ~values.reads_as(cell.text, wanted))
    if isinstance(kind, (*_STAMPS, T.DateType)):
        return never
    return always if isinstance(kind, (*_WHOLE, *_FLOATING, T.DecimalType, T.BooleanType)) else (
        ~values.reads_as(cell.text, wanted))


def _breaks_bound(cell: Cell, bound: str, side: str) -> Column | None:
    if not bound or cell.rule.normal not in fixed.NUMERIC_TYPES or values.parse_bound(bound) is None:
        return None
    if isinstance(cell.data_type, (*_WHOLE, *_FLOATING, T.DecimalType)):
        return values.number_outside(cell.raw, cell.data_type, bound, side)
    return values.text_outside(cell.text, cell.number, bound, side)


def breaks_min(cell: Cell) -> Column | None:
    return _breaks_bound(cell, cell.rule.min_value, "min")


def breaks_max(cell: Cell) -> Column | None:
    return _breaks_bound(cell, cell.rule.max_value, "max")


# -- all rules of one column -------------------------------------------------------------------


def rule_tests(cell: Cell) -> list[tuple[str, Column]]:
    """(check, broken?) in the order in which the checks apply.

    A date or timestamp column with a format is judged by the format alone: once it fits, type
    and bounds are not looked at.
    """
    if has_format(cell.rule):
        order = [(fixed.ALLOWED, breaks_allowed), (fixed.PATTERN, breaks_pattern), (fixed.FORMAT, breaks_format)]
    else:
        order = [
            (fixed.ALLOWED, breaks_allowed), (fixed.PATTERN, breaks_pattern), (fixed.VALUE_TYPE, breaks_type),
            (fixed.MINIMUM, breaks_min), (fixed.MAXIMUM, breaks_max),
        ]
    tests = [(check, test(cell)) for check, test in order]
    return [(check, broken) for check, broken in tests if broken is not None]


def cell_check(cell: Cell) -> Column | None:
    """Name of the first check the cell fails, null for a good cell.

    None when the rules cannot fail on this column, so that it need not be read at all.
    """
    tests = rule_tests(cell)
    if not tests and not cell.rule.required:
        return None
    verdict = F.when(cell.blank, F.lit(fixed.REQUIRED if cell.rule.required else None).cast("string"))
    for check, broken in tests:
        verdict = verdict.when(broken, F.lit(check))
    return verdict


def expected_text(rule: Rule, check: str) -> str | None:
    """What an issue of this check reports as expected; lists are reported apart."""
    return {
        fixed.REQUIRED: fixed.EXPECTED_NON_EMPTY,
        fixed.PATTERN: rule.pattern,
        fixed.FORMAT: rule.format,
        fixed.VALUE_TYPE: rule.type,
        fixed.MINIMUM: f">= {rule.min_value}",
        fixed.MAXIMUM: f"<= {rule.max_value}",
    }.get(check)
