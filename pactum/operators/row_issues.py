"""From cells to issues: melt, count, sample.

The rules of all contracts that a table's rows fall under are compiled together (``Compiled``): rules alike on
one received column are one test, however many contracts have them.  A row of a table with many contracts meets
a small table that says which test each contract has on which column, so contracts are data and not branches,
and the table is scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum import fixed
from pactum.functions.text import redact
from pactum.operators import catalog
from pactum.operators.cell_checks import Cell, cell_check, expected_text, has_format, locate_cells, stage_cells
from pactum.types import Contract, Rule

ROW_CHECKS = [
    fixed.REQUIRED, fixed.ALLOWED, fixed.PATTERN, fixed.FORMAT, fixed.VALUE_TYPE, fixed.MINIMUM, fixed.MAXIMUM,
]


def _test_key(rule: Rule) -> tuple:
    """Rules with the same key on the same column pass and fail the same cells."""
    return (
        rule.normal, rule.required, rule.format if has_format(rule) else "", rule.pattern, tuple(rule.allowed_values),
        rule.min_value, rule.max_value,
    )


@dataclass
class Slot:
    """One received column and the different tests that contracts have on it.  A contract with several rules
    on one column has a slot for each."""

    source: str
    tests: dict[tuple, Column | None] = field(default_factory=dict)
    cell: Cell | None = None


class Compiled:
    """Contracts compiled against one table.

    ``staged`` is the table with stripped texts and numbers worked out once a column.  ``contract_col`` names
    the column with a row's contract; without it all rows fall under the single contract given.
    """

    def __init__(
        self, df: DataFrame, contracts: list[Contract], contract_col: str | None,
        test: Callable[[Cell], Column | None] = cell_check, key: Callable[[Rule], tuple] = _test_key,
        applies: Callable[[Rule], bool] = lambda rule: True,
    ):
        if contract_col is None and len(contracts) != 1:
            raise ValueError("rows of several contracts need a column that names their contract")
        self.contracts, self.contract_col, self.session = contracts, contract_col, df.sparkSession
        found = [(c.name, cell) for c in contracts for cell in locate_cells(df, c) if applies(cell.rule)]
        self.staged, cells = stage_cells(df, [cell for _, cell in found])
        self.slots: list[Slot] = []
        self.vectors: dict[str, dict[int, int]] = {c.name: {} for c in contracts}
        self.rules: list[tuple[str, int, int, Rule]] = []  # contract, slot, position, rule
        by_source: dict[str, list[int]] = {}
        for (name, _), cell in zip(found, cells):
            taken, own = self.vectors[name], by_source.setdefault(cell.source, [])
            slot = next((n for n in own if n not in taken), None)
            if slot is None:
                slot = len(self.slots)
                own.append(slot)
                self.slots.append(Slot(cell.source))
            tests = self.slots[slot].tests
            if key(cell.rule) not in tests:
                tests[key(cell.rule)] = test(cell)
            # bounds need a number, which only some rules have staged
            if self.slots[slot].cell is None or cell.number_as:
                self.slots[slot].cell = cell
            taken[slot] = list(tests).index(key(cell.rule))
            self.rules.append((name, slot, cell.pos, cell.rule))

    def marks(self) -> list[Column]:
        """By slot, the check that a row's cell fails, null for a good cell."""
        found = []
        for n, slot in enumerate(self.slots):
            mark = F
            for number, verdict in enumerate(slot.tests.values()):
                if verdict is None:
                    continue
                if self.contract_col is None:
                    mark = verdict
                else:
                    mark = mark.when(F.col(f"__test_{n}") == number, verdict)
            found.append(F.lit(None).cast("string") if mark is F else mark)
        return found

    def routed(self) -> DataFrame:
        """The table, each row with its contract's number of a test for each slot.

        The joined table has a row for each contract; contracts are on the driver already, behind a check of
        their number (``types.collect_contracts``), so it is small enough for a broadcast.
        """
        if self.contract_col is None:
            return self.staged
        names = [c.name for c in self.contracts]
        columns = {"__contract": pa.array(names, pa.string())} | {
            f"__test_{n}": pa.array([self.vectors[name].get(n) for name in names], pa.int32()) for n in range(len(self.slots))
        }
        vectors = self.session.createDataFrame(pa.table(columns))
        return self.staged.join(F.broadcast(vectors), F.col(self.contract_col) == F.col("__contract"), "left")

    def lookup(self) -> DataFrame:
        """contract, slot, pos, column, expected (by check) and accepted values of every rule."""
        expected = [
            {check: text for check in ROW_CHECKS if (text := expected_text(rule, check)) is not None} for _, _, _, rule in self.rules
        ]
        return self.session.createDataFrame(pa.table({
            "contract": pa.array([name for name, _, _, _ in self.rules], pa.string()),
            "slot": pa.array([slot for _, slot, _, _ in self.rules], pa.int32()),
            "pos": pa.array([pos for _, _, pos, _ in self.rules], pa.int32()),
            "column": pa.array([rule.column for _, _, _, rule in self.rules], pa.string()),
            "__expected": pa.array([list(e.items()) for e in expected], pa.map_(pa.string(), pa.string())),
            "__allowed": pa.array([list(rule.allowed_values) for _, _, _, rule in self.rules], pa.list_(pa.string())),
        }))

    def bad_cells(self, keep: list[Column], with_value: bool) -> DataFrame:
        """One row (keep, contract, slot, check[, value]) per bad cell, from one scan.

        The marks are worked out once, in a projection; a row without any gives the explode a null instead
        of an array and ends there, so a clean row costs its checks and nothing more.  Only the contracts'
        columns are read, and a value is printed for bad cells alone.
        """
        names = [f"__mark_{n}" for n in range(len(self.slots))]
        contract = F.lit(self.contracts[0].name) if self.contract_col is None else F.col(self.contract_col)
        printed = {slot.source: f"__source_{n}" for n, slot in enumerate(self.slots)}
        shown = {slot.source: slot.cell for slot in self.slots}
        marked = self.routed().select(
            *keep, contract.alias("contract"), *[mark.alias(name) for name, mark in zip(names, self.marks())],
            *([F.col(cell.text_as or f"`{source}`").alias(printed[source]) for source, cell in shown.items()] if with_value else []),
        )
        kept = [c for c in marked.columns if not c.startswith(("__mark_", "__source_"))]
        entries = []
        for n, (slot, name) in enumerate(zip(self.slots, names)):
            value = F.col(printed[slot.source])
            entries.append(F.when(F.col(name).isNotNull(), F.struct(
                F.lit(n).alias("slot"), F.col(name).alias("check"),
                *([(value if slot.cell.is_text else value.cast("string")).alias("value")] if with_value else []))))
        if not entries:
            empty = "array<struct<slot:int,check:string,value:string>>" if with_value else "array<struct<slot:int,check:string>>"
            cells = F.lit(None).cast(empty)
        else:
            cells = F.when(F.coalesce(*names).isNotNull() if len(names) > 1 else F.col(names[0]).isNotNull(), F.array(*entries))
        return marked.select(*kept, F.explode(cells).alias("cell")).filter(F.col("cell").isNotNull()).select(*kept, "cell.*")

    def described(self, cells: DataFrame) -> DataFrame:
        """Add position, column name, expected value and severity, by contract and slot; only bad cells, or
        their counts, come this far.  The rules are on the driver already, as in ``routed``."""
        allowed = (F.col("check") == fixed.ALLOWED) & (F.size("__allowed") > 0)
        return (
            cells.join(F.broadcast(self.lookup()), ["contract", "slot"])
            .withColumn("severity", F.lit(fixed.FAIL))
            .withColumn("expected", F.try_element_at("__expected", F.col("check")))
            .withColumn("expected_values", F.when(allowed, F.col("__allowed")))
            .drop("__expected", "__allowed", "slot")
        )


def first_failures(df: DataFrame, contract: Contract, keep: list[str]) -> DataFrame:
    """One ``check_<column>`` per contract column, beside the columns in ``keep``."""
    staged, cells = stage_cells(df, locate_cells(df, contract))
    checks = [(cell, cell_check(cell)) for cell in cells]
    return staged.select(*keep, *[check.alias(f"check_{cell.rule.column}") for cell, check in checks if check is not None])


def row_issues(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """One issue per bad cell, blank required cells included, over the whole table (no cap)."""
    compiled = Compiled(df, contracts, contract_col)
    cells = compiled.described(compiled.bad_cells([dataset.alias("dataset"), row.cast("long").alias("row")], with_value=True))
    return cells.select(
        "dataset", "contract", "pos", "row", "severity", "check", "column", "expected", "expected_values",
        redact(F.col("value")).alias("actual"),
    )


def violation_counts(
    df: DataFrame, contracts: list[Contract], dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """Exact number of bad cells per dataset, column and check.

    Counts are combined on the map side: one row per (dataset, column, check) and task is
    shuffled, however many cells are bad and however unevenly they are spread.
    """
    compiled = Compiled(df, contracts, contract_col)
    counts = compiled.bad_cells([dataset.alias("dataset")], with_value=False).groupBy("dataset", "contract", "slot", "check").agg(
        F.count(F.lit(1)).alias("violations"))
    return compiled.described(counts).select("dataset", "contract", "pos", "column", "check", "violations")


def bad_cell_counts(
    df: DataFrame, contracts: list[Contract], dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """How many bad cells a dataset has under its contract, as issues (severity and ``n``) for a status: no values,
    no rows, one sum a dataset and task."""
    compiled = Compiled(df, contracts, contract_col)
    counts = compiled.bad_cells([dataset.alias("dataset")], with_value=False).groupBy("dataset", "contract").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("severity", F.lit(fixed.FAIL))


def required_issues(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """One issue per required column with blank cells: how many, and the first row.

    Reads the required columns only; the count and minimum are combined on the map side.
    """
    compiled = Compiled(
        df, contracts, contract_col, test=lambda cell: F.when(cell.blank, F.lit(fixed.REQUIRED)), key=lambda rule: (),
        applies=lambda rule: rule.required)
    keep = [dataset.alias("dataset"), row.cast("long").alias("row")]
    found = compiled.bad_cells(keep, with_value=False).groupBy("dataset", "contract", "slot", "check").agg(
        F.count(F.lit(1)).alias("blank_count"), F.min("row").alias("row")
    )
    return compiled.described(found).select(
        "dataset", "contract", "pos", "row", "severity", "check", "column", "expected", "expected_values",
        F.concat(F.col("blank_count").cast("string"), F.lit(" empty values")).alias("actual"),
    )


def issue_sample(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
    cap: int = fixed.ISSUE_CAP,
) -> DataFrame:
    """The first ``cap`` issues of every dataset and the warning that the cap was reached.

    Order: contract column, then cell issues by row, then the column's blank-cells issue.  This
    is a top-k report beside the exact ``violation_counts``; ``row_number() <= cap`` is pruned
    inside every task before the shuffle, so a dataset with most of the violations sends at most
    ``cap`` rows per task.
    """
    cells = row_issues(df, contracts, row, dataset, contract_col).filter(F.col("check") != fixed.REQUIRED)
    blanks = required_issues(df, contracts, row, dataset, contract_col)
    issues = cells.withColumn("late", F.lit(0)).unionByName(blanks.withColumn("late", F.lit(1)))
    order = Window.partitionBy("dataset", "contract").orderBy("pos", "late", "row")
    first = issues.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("late")
    # the issue that reaches the cap brings the warning along, so nothing is computed twice
    fields = {
        "pos": F.lit(None).cast("int"), "row": F.lit(None).cast("long"), "severity": F.lit(fixed.WARN),
        "check": F.lit(fixed.ISSUE_LIMIT), "column": F.lit("*"), "expected": F.lit(f"at most {cap} sampled issues"),
        "expected_values": F.lit(None).cast("array<string>"), "actual": F.lit(f"{cap} sampled issues"),
        "n": F.lit(cap + 1),
    }
    issue = F.struct(*fields)
    warning = F.struct(*[value.alias(name) for name, value in fields.items()])
    listed = F.when(F.col("n") == cap, F.array(issue, warning)).otherwise(F.array(issue))
    return first.select("dataset", "contract", F.explode(listed).alias("i")).select("dataset", "contract", "i.*")


def cell_totals(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """Exact row findings of the whole table: one per dataset, contract, column and check, with the number of
    cells in ``n`` and the first of them as example.

    Nothing is capped and nothing is collected: counts and first rows are combined on the map
    side.  Reports and remediation plans built from it cover every violation.
    """
    compiled = Compiled(df, contracts, contract_col)
    cells = compiled.bad_cells([dataset.alias("dataset"), row.cast("long").alias("row")], with_value=True)
    first = cells.groupBy("dataset", "contract", "slot", "check").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min_by("value", "row").alias("value")
    )
    blank = F.col("check") == fixed.REQUIRED
    actual = F.when(blank, F.concat(F.col("n").cast("string"), F.lit(" empty values"))).otherwise(redact(F.col("value")))
    return compiled.described(first).withColumn("actual", actual).drop("value")


def unique_totals(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """Columns flagged ``unique`` in which values repeat, as ``cell_totals``: one finding a dataset, contract and
    column, ``n`` being the cells that share their value with another cell, ``row`` the first of them.

    Values are compared as stripped texts; blank cells are none.  First only hashes meet, eight bytes a cell,
    combined on the map side; cells whose hash occurs once go no further.  Of the others the values themselves
    are compared, so a chance hit of two hashes is no finding.  A value held by a third of all rows is one row a
    task in both steps.
    """
    compiled = Compiled(
        df, contracts, contract_col, test=lambda cell: F.when(~cell.blank, F.lit(fixed.UNIQUE)), key=lambda rule: (),
        applies=lambda rule: rule.unique)
    if not compiled.slots:
        return compiled.described(compiled.bad_cells([dataset.alias("dataset"), row.cast("long").alias("row")], True)).select(
            "dataset", "contract", "pos", "column", "check", "severity", "expected", "expected_values", F.col("value").alias("actual"), "row",
            F.lit(0).cast("long").alias("n"))
    by = ["dataset", "contract", "slot"]
    cells = compiled.bad_cells([dataset.alias("dataset"), row.cast("long").alias("row")], with_value=True).withColumn("hash", F.xxhash64("value"))
    repeated = cells.groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
    shared = cells.join(repeated, [*by, "hash"], "left_semi").groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).filter(F.col("n") > 1)
    found = shared.groupBy(*by).agg(F.sum("n").alias("n"), F.min("row").alias("row")).withColumn("check", F.lit(fixed.UNIQUE))
    return compiled.described(found).withColumn("expected", F.lit("unique values")).withColumn(
        "actual", F.concat(F.col("n").cast("string"), F.lit(" cells with shared values"))).select(
        "dataset", "contract", "pos", "column", "check", "severity", "expected", "expected_values", "actual", "row", "n")


def issue_summary(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
) -> DataFrame:
    """``cell_totals`` as ``issues``, numbered per dataset and contract."""
    late = (F.col("check") == fixed.REQUIRED).cast("int")
    order = Window.partitionBy("dataset", "contract").orderBy("pos", late, "row", "check")
    totals = cell_totals(df, contracts, row, dataset, contract_col)
    return catalog.describe_issues(totals.withColumn("ord", F.row_number().over(order).cast("long")), "n")


def quality_report(
    df: DataFrame, contracts: list[Contract], row: Column, dataset: Column, contract_col: str | None = None,
    cap: int = fixed.ISSUE_CAP,
) -> DataFrame:
    """The sampled row issues as ``issues`` rows with message, impact and order."""
    sample = issue_sample(df, contracts, row, dataset, contract_col, cap)
    return catalog.describe_issues(sample.withColumn("ord", F.col("n").cast("long")))
