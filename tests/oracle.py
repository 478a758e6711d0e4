"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

``python -m tests.oracle [--sf DIR] [name…]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from decimal import Decimal

import duckdb

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith("decimal") or t.startswith("hugeint"):
        return t
    return {"long": "bigint", "varchar": "string", "integer": "int"}.get(t, t)


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if sql is None:
        return "" if left else "no rows"
    cur = duck(sf_dir).execute(sql)
    duck_names = [d[0] for d in cur.description]
    types = dict(zip(duck_names, [str(d[1]) for d in cur.description]))
    if sorted(duck_names) != names:
        return f"columns {names} against {sorted(duck_names)}"
    spark_types = dict(df.dtypes)
    off = {c: (spark_types[c], types[c]) for c in names if kind(spark_types[c]) != kind(types[c])}
    if off:
        return f"types {off}"
    order = [duck_names.index(c) for c in names]
    right = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    left.sort(key=sort_key)
    right.sort(key=sort_key)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if not wrong:
        return ""
    a, b = wrong[0]
    diff = {c: (x, y) for c, x, y in zip(names, a, b) if x != y}
    return f"{len(wrong)} of {len(left)} rows differ, first {diff}"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("uqframe")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="uqframe-tests-"))
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(argv: list[str]) -> int:
    from uqframe.catalogue import registered

    sf_dir = SF
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark, bad = session(), 0
    queries = registered()
    for name in argv or queries:
        fn, sql = queries[name]
        start = time.time()
        try:
            problem = compare(spark, name, fn, sql, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        mark = "FAIL" if problem else "ok" if sql else "rows"
        print(f"{mark:5}{time.time() - start:7.2f}s {name} {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
