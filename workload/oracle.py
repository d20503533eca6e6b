"""SQL of the checking engine: shared parts, put together as WITH clauses."""

from __future__ import annotations

from pactum.types import Contract, Rule
from workload import inputs

STRIP = "trim({v}, concat(' ', chr(9)))"
NUMBER = r"[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|[+-]?(inf|infinity|nan)"
DECIMAL = r"[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|[+-]?(inf|infinity|s?nan\d*)"
TIMESTAMP = (
    r"\d{4}-\d{2}-\d{2}(.([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?"
    r"(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?)?"
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def type_ok(kind: str, v: str) -> str | None:
    return {
        "int": rf"regexp_full_match({v}, '[+-]?\d+(_\d+)*')",
        "long": rf"regexp_full_match({v}, '[+-]?\d+(_\d+)*')",
        "float": f"regexp_full_match(lower({v}), '{NUMBER}')",
        "double": f"regexp_full_match(lower({v}), '{NUMBER}')",
        "decimal": f"regexp_full_match(lower(replace({v}, '_', '')), '{DECIMAL}')",
        "boolean": f"lower({v}) IN ('true', 'false', '1', '0', 'yes', 'no')",
        "date": rf"(regexp_full_match({v}, '\d{{4}}-\d{{2}}-\d{{2}}') AND try_cast({v} AS date) IS NOT NULL)",
        "timestamp": f"(regexp_full_match({v}, '{TIMESTAMP}') AND try_cast(left({v}, 10) AS date) IS NOT NULL)",
    }.get(kind)


def cell_case(rule: Rule, column: str) -> str:
    """First failed check of a text cell."""
    v = STRIP.format(v=column)
    parts = [f"WHEN {column} IS NULL OR {v} = '' THEN {quote('value.required') if rule.required else 'NULL'}"]
    if rule.allowed_values:
        parts.append(f"WHEN {v} NOT IN ({', '.join(map(quote, rule.allowed_values))}) THEN 'value.allowed'")
    if rule.pattern:
        parts.append(f"WHEN NOT regexp_full_match({v}, {quote(rule.pattern)}) THEN 'value.pattern'")
    if rule.format and rule.normal in ("date", "timestamp"):
        parts.append(f"WHEN try_strptime({v}, {quote(rule.format)}) IS NULL THEN 'value.format'")
    else:
        ok = type_ok(rule.normal, v)
        if ok:
            parts.append(f"WHEN NOT {ok} THEN 'value.type'")
        number = f"try_cast(replace({v}, '_', '') AS double)"
        if rule.min_value or rule.max_value:
            parts.append(f"WHEN isnan({number}) THEN 'value.type'")
        if rule.min_value:
            parts.append(f"WHEN {number} < {rule.min_value} THEN 'value.min'")
        if rule.max_value:
            parts.append(f"WHEN {number} > {rule.max_value} THEN 'value.max'")
    return "CASE " + " ".join(parts) + " END"


def typed_case(rule: Rule, column: str) -> str:
    """First failed check of a cell of a table whose columns have the contract's types already."""
    parts = [f"WHEN {column} IS NULL THEN {quote('value.required') if rule.required else 'NULL'}"]
    if rule.allowed_values:
        parts.append(f"WHEN {column} NOT IN ({', '.join(map(quote, rule.allowed_values))}) THEN 'value.allowed'")
    if rule.pattern:
        parts.append(f"WHEN NOT regexp_full_match({column}, {quote(rule.pattern)}) THEN 'value.pattern'")
    if rule.min_value:
        parts.append(f"WHEN {column} < {rule.min_value} THEN 'value.min'")
    if rule.max_value:
        parts.append(f"WHEN {column} > {rule.max_value} THEN 'value.max'")
    return "CASE " + " ".join(parts) + " END"


REDACTED = (
    "CASE WHEN strpos({v}, '@') > 0 THEN concat(left(split_part({v}, '@', 1), 1), '***@', "
    "substr({v}, strpos({v}, '@') + 1)) WHEN length({v}) > 80 THEN concat(left({v}, 77), '...') ELSE {v} END"
)


def expected_of(rule: Rule) -> str:
    pairs = [
        ("value.required", "non-empty value"), ("value.pattern", rule.pattern), ("value.format", rule.format),
        ("value.type", rule.type), ("value.min", f">= {rule.min_value}"), ("value.max", f"<= {rule.max_value}"),
    ]
    return 'CASE "check" ' + " ".join(f"WHEN {quote(c)} THEN {quote(e)}" for c, e in pairs) + " END"


def cells_sql(contract: Contract, source: str, columns: set[str], where: str = "true", text: bool = True,
              keep: str = 'dataset, "row"') -> str:
    """Every bad cell of a table under one contract."""
    case = cell_case if text else typed_case
    return " UNION ALL ".join(
        f'SELECT {keep}, {quote(contract.name)} AS contract, {pos} AS pos, "check", {quote(rule.column)} AS "column", '
        f"{expected_of(rule)} AS expected, "
        f"CASE \"check\" WHEN 'value.allowed' THEN {quote(', '.join(rule.allowed_values))} END AS domain, "
        f"{STRIP.format(v='v')} AS v FROM (SELECT {keep}, CAST({rule.column} AS varchar) AS v, "
        f'{case(rule, rule.column)} AS "check" FROM {source} WHERE {where}) WHERE "check" IS NOT NULL'
        for pos, rule in enumerate(contract.rules) if rule.column in columns
    )


def rules_values(contracts: list[Contract]) -> str:
    rows = ", ".join(
        f"({quote(c.name)}, {pos}, {quote(r.column)}, {quote(r.type)}, {str(r.required).lower()})"
        for c in contracts for pos, r in enumerate(c.rules)
    )
    return f'SELECT * FROM (VALUES {rows}) AS t(contract, pos, "column", type, required)'


def norm_type(t: str) -> str:
    base = f"trim(split_part(lower(trim({t})), '(', 1))"
    return (
        f"CASE {base} WHEN 'integer' THEN 'int' WHEN 'int32' THEN 'int' WHEN 'int64' THEN 'long' "
        "WHEN 'bigint' THEN 'long' WHEN 'str' THEN 'string' WHEN 'varchar' THEN 'string' WHEN 'text' THEN 'string' "
        "WHEN 'bool' THEN 'boolean' WHEN 'float64' THEN 'double' WHEN 'numeric' THEN 'decimal' "
        f"WHEN 'timestamp_ntz' THEN 'timestamp' WHEN 'datetime' THEN 'timestamp' ELSE {base} END"
    )


def name_form(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"


_DELIVERY_COLUMNS = {"customer_id", "mail", "birth_date", "amount", "opt_in", "seen_at", "priority"}

PARTS = {
    "deliveries": inputs.deliveries_sql(inputs.DUCK),
    "feeds": inputs.feeds_sql(inputs.DUCK),
    "feed_columns": inputs.feed_columns_sql(),
    "rules": rules_values(inputs.CONTRACTS),
    # all bad cells of deliveries under the one contract that covers each column
    "delivery_cells": cells_sql(inputs.DELIVERY, "deliveries", _DELIVERY_COLUMNS),
    # all bad cells of the fleet, each feed under its own contract
    "fleet_cells": " UNION ALL ".join(
        cells_sql(c, "deliveries", _DELIVERY_COLUMNS, where=f"contract = {quote(c.name)}") for c in inputs.CONTRACTS
    ),
    # schema comparison
    "expected": 'SELECT f.dataset, f.contract, r.pos AS exp_pos, r."column" AS exp_column, r.type AS exp_type, '
                'r.required, lower(r."column") AS key FROM feeds f JOIN rules r USING (contract)',
    "received": 'SELECT dataset, pos AS src_pos, "column" AS src_column, type AS src_type, lower("column") AS key '
                "FROM feed_columns",
    "matched": "SELECT e.*, r.src_pos, r.src_column, r.src_type FROM expected e JOIN received r USING (dataset, key) "
               "QUALIFY row_number() OVER (PARTITION BY dataset, e.contract, exp_pos ORDER BY r.src_pos DESC) = 1",
    "absent": "SELECT e.* FROM expected e ANTI JOIN received r USING (dataset, key)",
    "surplus": "SELECT r.*, f.contract FROM received r JOIN feeds f USING (dataset) "
               "ANTI JOIN expected e ON r.dataset = e.dataset AND f.contract = e.contract AND r.key = e.key",
    "forms": f"SELECT a.dataset, a.contract, a.exp_pos, a.exp_column, s.src_pos, s.src_column, s.key AS src_key, "
             f"{name_form('a.exp_column')} AS l, {name_form('s.src_column')} AS r "
             "FROM absent a JOIN surplus s USING (dataset, contract)",
    "lookalikes": "SELECT * FROM forms WHERE l <> '' AND r <> '' AND (contains(l, r) OR contains(r, l) OR "
               "(levenshtein(l, r) <= 2 AND least(length(l), length(r)) >= 4))",
    "renamed": "SELECT * FROM lookalikes QUALIFY row_number() OVER (PARTITION BY dataset, contract, exp_pos ORDER BY src_pos) = 1",
    "typed": f"SELECT *, {norm_type('exp_type')} AS want, {norm_type('src_type')} AS got FROM matched",
    "findings": """
        SELECT a.dataset, a.contract, 0 AS phase, a.exp_pos AS pos, 'column.renamed' AS "check", 'FAIL' AS severity,
          a.exp_column AS "column", a.exp_column AS expected, r.src_column AS actual
          FROM absent a JOIN renamed r ON a.dataset = r.dataset AND a.contract = r.contract AND a.exp_pos = r.exp_pos
        UNION ALL
        SELECT a.dataset, a.contract, 0, a.exp_pos, 'column.missing',
          CASE WHEN a.required THEN 'FAIL' ELSE 'WARN' END, a.exp_column, a.exp_type, NULL
          FROM absent a ANTI JOIN renamed r ON a.dataset = r.dataset AND a.contract = r.contract AND a.exp_pos = r.exp_pos
        UNION ALL
        SELECT dataset, contract, 0, exp_pos,
          CASE WHEN (want = 'int' AND got = 'long') OR (want = 'float' AND got = 'double')
               THEN 'type.promotion' ELSE 'type.change' END,
          CASE WHEN (want = 'int' AND got = 'long') OR (want = 'float' AND got = 'double') THEN 'WARN' ELSE 'FAIL' END,
          exp_column, exp_type, src_type FROM typed WHERE want <> got
        UNION ALL
        SELECT s.dataset, s.contract, 1, s.src_pos, 'column.extra', 'WARN', s.src_column, NULL, s.src_type
          FROM surplus s ANTI JOIN renamed r ON s.dataset = r.dataset AND s.contract = r.contract AND s.src_pos = r.src_pos
        """,
    # row issues of the fleet: sample of the first twenty
    "fleet_candidates": f"""
        SELECT dataset, contract, pos, 0 AS late, "row", "check", "column", expected, domain,
          {REDACTED.format(v='v')} AS actual FROM fleet_cells WHERE "check" <> 'value.required'
        UNION ALL
        SELECT dataset, contract, pos, 1, min("row"), 'value.required', "column", 'non-empty value', NULL,
          concat(CAST(count(*) AS varchar), ' empty values')
          FROM fleet_cells WHERE "check" = 'value.required' GROUP BY dataset, contract, pos, "column"
        """,
    "fleet_first": 'SELECT *, row_number() OVER (PARTITION BY dataset, contract ORDER BY pos, late, "row") AS n '
                   "FROM fleet_candidates QUALIFY n <= 20",
    "fleet_sample": """
        SELECT dataset, contract, n, 'FAIL' AS severity, "check", "column", expected, domain, actual, "row"
          FROM fleet_first
        UNION ALL
        SELECT dataset, contract, 21, 'WARN', 'quality.issue_limit', '*', 'at most 20 sampled issues', NULL,
          '20 sampled issues', NULL FROM fleet_first WHERE n = 20
        """,
    # row issues of the fleet: one for each column and check, with the number of its cells
    "fleet_totals": f"""
        SELECT dataset, contract, pos, "check", "column", any_value(expected) AS expected,
          CASE WHEN "check" <> 'value.required' THEN any_value(domain) END AS domain, min("row") AS "row", count(*) AS n,
          CASE WHEN "check" = 'value.required' THEN concat(CAST(count(*) AS varchar), ' empty values')
               ELSE arg_min({REDACTED.format(v='v')}, "row") END AS actual
        FROM fleet_cells GROUP BY dataset, contract, pos, "check", "column"
        """,
    "merged": """
        SELECT dataset, contract, row_number() OVER (PARTITION BY dataset, contract ORDER BY part, a, b) AS ord, severity,
          "check", "column", expected, domain, actual, "row", weight FROM (
          SELECT dataset, contract, 0 AS part, phase AS a, pos AS b, severity, "check", "column", expected,
            CAST(NULL AS varchar) AS domain, actual, CAST(NULL AS bigint) AS "row", 1 AS weight FROM findings
          UNION ALL
          SELECT dataset, contract, 1, row_number() OVER (
              PARTITION BY dataset, contract ORDER BY pos, "check" = 'value.required', "row", "check"), 0, 'FAIL', "check",
            "column", expected, domain, actual, "row", n FROM fleet_totals)
        """,
    "states": """
        SELECT f.dataset, f.contract,
          CASE WHEN coalesce(x.fails, 0) > 0 THEN 'FAIL' WHEN coalesce(x.warns, 0) > 0 THEN 'WARN' ELSE 'PASS' END
            AS status, coalesce(x.fails, 0) AS fail_count, coalesce(x.warns, 0) AS warn_count
        FROM feeds f LEFT JOIN (
          SELECT dataset, contract, CAST(sum(weight) FILTER (severity = 'FAIL') AS bigint) AS fails,
            CAST(sum(weight) FILTER (severity = 'WARN') AS bigint) AS warns
          FROM merged GROUP BY dataset, contract) x USING (dataset, contract)
        """,
}

NEEDS = {
    "delivery_cells": ["deliveries"], "fleet_cells": ["deliveries"], "expected": ["feeds", "rules"],
    "received": ["feed_columns"], "matched": ["expected", "received"], "absent": ["expected", "received"],
    "surplus": ["expected", "received", "feeds"], "forms": ["absent", "surplus"], "lookalikes": ["forms"],
    "renamed": ["lookalikes"], "typed": ["matched"], "findings": ["absent", "surplus", "renamed", "typed"],
    "fleet_candidates": ["fleet_cells"], "fleet_first": ["fleet_candidates"], "fleet_sample": ["fleet_first"],
    "fleet_totals": ["fleet_cells"], "merged": ["findings", "fleet_totals"], "states": ["feeds", "merged"],
}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def query(final: str, *parts: str, over: dict[str, str] | None = None, **more: str) -> str:
    """``WITH`` the parts (and what they need), extra named parts, then the final select.  ``over`` puts other
    inputs in the place of parts of the same name."""
    held = PARTS | (over or {})
    ctes = [(name, held[name]) for name in _order(list(parts), [])] + list(more.items())
    if not ctes:
        return final
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes) + " " + final
