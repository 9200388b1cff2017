"""Run registered queries next to their SQL in DuckDB and compare rows, types and values.

``python tests/oracle.py [sf] [key ...]`` prints one line per key.
"""
from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _text(value) -> str:
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, sf_dir: str) -> tuple[str, int]:
    """Empty string when equal, else what differs; and the row count."""
    df = run(spark, sf_dir)
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}", len(got)
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return "", len(got)
    in_a, in_b = set(a), set(b)
    only_a, only_b = sorted(in_a - in_b)[:3], sorted(in_b - in_a)[:3]
    return f"{len(a)} rows vs {len(b)}; {sorted(names)}\n   spark only {only_a}\n   sql only   {only_b}", len(got)


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    spark = make_session()
    con = connect(sf_dir)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            if key in oracles:
                problem, n = compare(spark, con, queries[key], oracles[key], sf_dir)
            else:
                problem, n = "", queries[key](spark, sf_dir).count()
        except Exception as error:  # report and go on with the next key
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if key in oracles else "rows")
        print(f"{mark:5}{key:26}{n:8} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(keys)} keys, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
