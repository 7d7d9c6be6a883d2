"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    out = []
    for r in rows:
        out.append(tuple(_plain(r[n]) for n in order))
    return [columns[n] for n in order], sorted(out, key=repr)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "as_tuple"):  # decimals would be a type mismatch
        return ("decimal", str(v))
    return v


def compare(spark, con, name, run, sql, folder):
    """``(seconds, sql_seconds, rows, problem or None)``."""
    start = time.time()
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, 0.0, len(got), None if got else "no rows"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_took = time.time() - start
    got_names, got_rows = canonical(df.columns, got)
    want_names, want_rows = canonical(names, want)
    if got_names != want_names:
        return took, sql_took, len(got), f"columns {got_names} != {want_names}"
    if len(got_rows) != len(want_rows):
        return took, sql_took, len(got), f"rows {len(got_rows)} != {len(want_rows)}"
    different = [(a, b) for a, b in zip(got_rows, want_rows) if a != b]
    if different:
        return took, sql_took, len(got), f"{len(different)} rows differ, first {different[0]}"
    if got_rows and [type(v) for v in got_rows[0]] != [type(v) for v in want_rows[0]]:
        return took, sql_took, len(got), f"types {got_rows[0]} != {want_rows[0]}"
    return took, sql_took, len(got), None


def main() -> int:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark, con = session(), database(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        try:
            took, sql_took, rows, problem = compare(spark, con, name, run, oracle.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            took, sql_took, rows, problem = 0.0, 0.0, 0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:32s} {took:6.2f}s {sql_took:6.2f}s {rows:8d} {problem or ''}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
