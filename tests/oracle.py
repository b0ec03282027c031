"""Run queries next to their SQL twins: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return "null"
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, function, sql: str) -> tuple[bool, str]:
    started = time.time()
    df = function(spark, sf_dir)
    table = df.toArrow()
    took = time.time() - started
    mine = rows_of(df.columns, list(zip(*[c.to_pylist() for c in table.columns])))
    if sql is None:
        return len(mine) > 0, f"{len(mine)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return True, f"{len(mine)} rows, {took:.1f}s"
    a, b = set(mine), set(theirs)
    return False, (
        f"{len(mine)} / {len(theirs)} rows; only Spark {sorted(a - b)[:3]}; "
        f"only SQL {sorted(b - a)[:3]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from verbena.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    folder = tempfile.mkdtemp(prefix="verbena-oracle-")
    spark = build_session(8, **settings, **{"spark.checkpoint.dir": folder})
    con = connect(sf_dir)
    wanted = sys.argv[2:] or list(entry.queries())
    bad = []
    for name in wanted:
        try:
            good, note = compare(
                spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name)
            )
        except Exception:
            good, note = False, traceback.format_exc(limit=3)[-1500:]
        print("ok  " if good else "BAD ", name, note, flush=True)
        if not good:
            bad.append(name)
    print(len(wanted) - len(bad), "of", len(wanted), "agree; bad:", bad)


if __name__ == "__main__":
    main()
