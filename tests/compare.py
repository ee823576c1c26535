"""Run registered queries against their SQL twins. ``python tests/compare.py [sf dir] [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None where the frame and the SQL agree, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from txnrisk.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(sf_dir)
    todo = sys.argv[2:] or list(e.queries())
    bad = 0
    for name in todo:
        started = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                got = e.queries()[name](spark, sf_dir).collect()
                found = f"(no SQL) {len(got)} rows {got[:3]}"
            else:
                found = compare(e.queries()[name](spark, sf_dir), con, sql)
        except Exception as err:  # report and go on with the next query
            found = f"{type(err).__name__}: {str(err)[:600]}"
        bad += found is not None and not found.startswith("(no SQL)")
        print(f"{time.time() - started:6.2f}s {name}: {found or 'ok'}", flush=True)
    print("missing oracle keys:", sorted(set(e.oracle_sql()) - set(e.queries())), "bad:", bad)
