"""Run registered queries against their SQL twins: ``python tools/check.py FOLDER [name prefix...]``."""

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        cells = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else (0.0 if v == 0 else v)
            elif v is not None and not isinstance(v, (str, int)):
                v = float(v) if v.__class__.__name__ == "Decimal" else str(v)
            if isinstance(v, bool):
                v = int(v)
            if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
                v = int(v)
            cells.append(repr(v))
        out.append(tuple(cells))
    return sorted(out), [names[i] for i in order]


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got, got_names = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return f"rows {len(got)}" + (" EMPTY" if not got else "")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_names = canonical(cursor.fetchall(), names)
    if got_names != want_names:
        return f"FAIL columns {got_names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return f"FAIL rows {len(got)} / {len(want)}\n    spark only: {extra}\n    sql only:   {lost}"
    return f"ok {len(got)}"


def main():
    folder, prefixes = sys.argv[1], sys.argv[2:]
    from tablemirror.plans import ORACLES, QUERIES
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    failed = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, fn, ORACLES.get(name), folder)
        except Exception as e:
            result = "FAIL " + "".join(traceback.format_exception_only(e))[:700] + traceback.format_exc()[-600:]
        failed += result.startswith("FAIL")
        print(f"{name:40s} {time.time() - start:6.1f}s  {result}", flush=True)
        spark.catalog.clearCache()
    print("failed:", failed)


if __name__ == "__main__":
    main()
