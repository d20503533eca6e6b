"""Run registered queries beside their SQL: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(columns), sorted((tuple(canonical(r[n]) for n in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb
    from workload.inputs import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, run, sql):
    started = time.time()
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if sql is None:
        return spent, len(ours[1]), "rows only"
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours == theirs:
        return spent, len(ours[1]), "ok"
    if ours[0] != theirs[0]:
        return spent, len(ours[1]), f"COLUMNS {ours[0]} vs {theirs[0]}"
    left, right = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
    return spent, len(ours[1]), (
        f"DIFFERENT {len(ours[1])} vs {len(theirs[1])} rows; only ours {sorted(left, key=repr)[:3]}; "
        f"only theirs {sorted(right, key=repr)[:3]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from pactum.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark, con = local_session("8", 8), duck(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args or queries:
        try:
            spent, n, verdict = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            spent, n, verdict = 0, -1, f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {n:8d} rows {spent:6.2f}s  {verdict}", flush=True)
    print(f"{bad} bad of {len(args or queries)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
