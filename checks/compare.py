"""Run every query on Spark and its check in DuckDB, and compare whole results.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normalised(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return float(value)
    return str(value)


def same(a: list[tuple], b: list[tuple]) -> str:
    """Empty when both hold the same rows; else what differs first."""
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    key = lambda row: [(v is None, str(type(v)), v) if not isinstance(v, float) else (False, "f", round(v, 6)) for v in row]
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        if x != y:
            return f"{x} against {y}"
    return ""


def session(app: str = "turnlake-compare"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName(app).config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def check(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    ours = [tuple(normalised(v) for v in row) for row in frame.select(*columns).collect()]
    if sql is None:
        return "" if ours else "no rows"
    print(f"     spark {time.time() - began:.1f}s", end=" ")
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    return same(ours, [tuple(normalised(row[i]) for i in order) for row in theirs.fetchall()])


def main(argv: list[str]) -> int:
    from checks.queries import ORACLES, QUERIES
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = session(), duck(folder), 0
    for name in names:
        began = time.time()
        try:
            problem = check(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s "
              f"{'' if name in ORACLES else '(rows only) '}{problem}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names) - bad}/{len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
