"""Run a query on Spark and its SQL on DuckDB and compare the sorted values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return str(v)


def _key(rows):
    return sorted(tuple(_norm(v) for v in row) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(row[c] for c in cols) for row in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL)"
    started = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    rows = res.fetchall()
    took_sql = time.time() - started
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(row[i] for i in order) for row in rows]
    a, b = _key(got), _key(want)
    if a == b:
        return len(a) > 0, f"rows={len(a)} {took:.1f}s sql {took_sql:.1f}s"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"rows {len(a)} vs {len(b)}, types differ or values: {diff}"


def session():
    from foldwright.session import build_session

    spark = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = session(), connect(sf)
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, fn, e.oracle_sql().get(name), sf)
        except Exception as ex:  # noqa: BLE001
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
