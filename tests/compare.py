"""Run queries against their SQL twins: python tests/compare.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row)
            for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def same(spark_rows, sql_rows):
    if len(spark_rows) != len(sql_rows):
        return False
    for left, right in zip(spark_rows, sql_rows):
        for a, b in zip(left, right):
            if isinstance(a, float) or isinstance(b, float):
                if abs(a - b) > 1e-9:
                    return False
            elif a != b:
                return False
    return True


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, bad = connect(sf_dir), oracle_sql(), []
    for name, run in queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir)
            types = {c: t for c, t in got.dtypes}
            got = got.toPandas()
            spent = time.time() - start
            start = time.time()
            expected = connection.execute(sql[name]).df() if name in sql else None
            duck = time.time() - start
        except Exception as error:
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        if expected is None:
            print(f"rows  {name}: {len(got)} rows, {spent:.1f}s", flush=True)
            continue
        left, right = canonical(got), canonical(expected)
        ok = sorted(got.columns) == sorted(expected.columns) and same(left, right)
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)}/{len(expected)} rows, "
              f"{spent:.1f}s duck {duck:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            print("   ", types, dict(expected.dtypes))
            for a, b in [(a, b) for a, b in zip(left, right) if a != b][:2]:
                print("    spark", str(a)[:700])
                print("    sql  ", str(b)[:700])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
