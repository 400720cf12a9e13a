"""Compare every registered query with its DuckDB statement on one scale factor."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {frame.columns} / {columns}"
    if ours == theirs:
        return None
    only = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"rows {len(ours)} / {len(theirs)}, only ours {only[0]}, only theirs {only[1]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    statements = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in statements:
                result = compare(spark, con, sf_dir, query, statements[name]) or "ok"
            else:
                result = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"FAILED {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:28} {time.time() - start:6.2f}s  {result}", flush=True)
