"""Schemas of the tables every operator reads or returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pactum import fixed


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

CONTRACT_RULES = _struct(
    ("contract", _S), ("version", _S), ("owner", _S), ("dataset", _S), ("pos", _I), ("column", _S),
    ("type", _S), ("required", _B), ("description", _S), ("format", _S), ("pattern", _S),
    ("allowed_values", T.ArrayType(_S)), ("min_value", _S), ("max_value", _S),
    ("unique", _B), ("pii", _B), ("criticality", _S),
)
COLUMNS_META = _struct(("dataset", _S), ("pos", _I), ("column", _S), ("type", _S), ("required", _B))
ASSIGNMENTS = _struct(("dataset", _S), ("contract", _S))
ISSUES = _struct(
    ("dataset", _S), ("contract", _S), ("ord", _L), ("severity", _S), ("check", _S), ("column", _S),
    ("message", _S), ("expected", _S), ("expected_values", T.ArrayType(_S)), ("actual", _S),
    ("row", _L), ("impact", _S),
)
CORRECTIONS = _struct(("dataset", _S), ("ord", _L), ("action", _S), ("target", _S), ("suggestion", _S))
REPORTS = _struct(
    ("contract", _S), ("source", _S), ("status", _S),
    ("counts", _struct((fixed.FAIL, _L), (fixed.WARN, _L), (fixed.INFO, _L))),
    ("issues", T.ArrayType(_struct(
        ("severity", _S), ("check", _S), ("column", _S), ("message", _S), ("expected", _S),
        ("expected_values", T.ArrayType(_S)), ("actual", _S), ("row", _L), ("impact", _S)))),
    ("corrections", T.ArrayType(_struct(("action", _S), ("target", _S), ("suggestion", _S)))),
)


def normal_type(name: str | None) -> str:
    """Driver-side twin of ``functions.names.type_form`` for compiled rules."""
    raw = (name or "").strip().lower().split("(", 1)[0].strip()
    return fixed.TYPE_ALIASES.get(raw, raw)


@dataclass(frozen=True)
class Rule:
    """One contract column, held on the driver while check expressions are built."""

    column: str
    type: str = fixed.DEFAULT_TYPE
    required: bool = False
    description: str = ""
    format: str = ""
    pattern: str = ""
    allowed_values: list[str] = field(default_factory=list)
    min_value: str = ""
    max_value: str = ""
    unique: bool = False
    pii: bool = False

    @property
    def normal(self) -> str:
        return normal_type(self.type)


@dataclass(frozen=True)
class Contract:
    name: str
    rules: list[Rule]
    version: str = fixed.DEFAULT_VERSION
    owner: str = fixed.DEFAULT_OWNER

    def rows(self, dataset: str | None = None) -> list[tuple]:
        return [
            (self.name, self.version, self.owner, dataset, pos, r.column, r.type, r.required,
             r.description, r.format, r.pattern, list(r.allowed_values), r.min_value, r.max_value,
             r.unique, r.pii, "")
            for pos, r in enumerate(self.rules)
        ]


def rules_frame(spark: SparkSession, *contracts: Contract) -> DataFrame:
    """Contracts written in code as a ``contract_rules`` DataFrame."""
    return spark.createDataFrame([row for c in contracts for row in c.rows()], CONTRACT_RULES)


def collect_contracts(rules: DataFrame, limit: int = 100 * fixed.MAX_CONTRACT_COLUMNS) -> list[Contract]:
    """Bring contract rules to the driver so that they can be compiled into expressions.

    A contract is a small declared document, but the size is checked all the same: more than
    ``limit`` rules is an error, never a silent cut.
    """
    rows = rules.select(*CONTRACT_RULES.fieldNames()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} contract rules; compile the contracts in groups")
    by_name: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["contract"], r["pos"])):
        by_name.setdefault(row["contract"], []).append(row)
    return [
        Contract(
            name=name,
            version=group[0]["version"] or fixed.DEFAULT_VERSION,
            owner=group[0]["owner"] or fixed.DEFAULT_OWNER,
            rules=[
                Rule(
                    column=r["column"], type=r["type"] or fixed.DEFAULT_TYPE, required=bool(r["required"]),
                    description=r["description"] or "", format=r["format"] or "", pattern=r["pattern"] or "",
                    allowed_values=list(r["allowed_values"] or []), min_value=r["min_value"] or "",
                    max_value=r["max_value"] or "", unique=bool(r["unique"]), pii=bool(r["pii"]),
                )
                for r in group
            ],
        )
        for name, group in by_name.items()
    ]
