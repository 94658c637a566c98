"""Run queries and their SQL side by side: python tests/oracle_check.py [sf_dir] [name …]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from stratalog.plans.standins import BASE_TABLES  # noqa: E402
from stratalog.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return f"{value}"


def rows_of(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, sql: str) -> str | None:
    """None when both agree, else what differs."""
    df = contract.queries()[name](spark, folder)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    have = {c[0]: str(c[1]) for c in cursor.description}
    odd = [(c, k, have[c]) for c, k in df.dtypes if kinds.get(k, k) != have[c]]
    theirs = rows_of(columns, cursor.fetchall())
    if ours != theirs:
        extra, lack = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(extra)[:2]}; only SQL {sorted(lack)[:2]}"
    return f"types {odd}" if odd else None


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = contract.oracle_sql(), 0
    for name in args or contract.queries():
        start = time.time()
        try:
            if name in oracles:
                fault = compare(spark, con, folder, name, oracles[name])
            else:
                fault = None if contract.queries()[name](spark, folder).collect() else "no rows"
        except Exception as e:  # a report over all queries
            fault = f"{type(e).__name__}: {str(e)[:700]}"
        bad += fault is not None
        print(f"{'ok  ' if fault is None else 'BAD '} {name} {time.time() - start:.1f}s {fault or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
