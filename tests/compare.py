"""Compare a registered query with its DuckDB oracle (also a small command line: python tests/compare.py SF_DIR NAME...)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(df, connection, sql: str) -> str:
    """Empty if both give the same rows; else what differs."""
    oracle = connection.sql(sql)
    expected_columns = oracle.columns
    expected = rows_of(expected_columns, oracle.fetchall())
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} and {sorted(expected_columns)}"
    if len(found) != len(expected):
        return f"{len(found)} rows, oracle {len(expected)}; first: {found[:2]} {expected[:2]}"
    wrong = [(a, b) for a, b in zip(found, expected, strict=True) if a != b]
    return f"{len(wrong)} of {len(found)} rows differ, as {wrong[:3]}" if wrong else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import make_session

    session, duck = make_session(), connect(sys.argv[1])
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    for name in names:
        began = time.time()
        try:
            if name in oracles:
                said = difference(queries[name](session, sys.argv[1]), duck, oracles[name]) or "same"
            else:
                said = f"no oracle, {queries[name](session, sys.argv[1]).count()} rows"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
