"""Runs queries beside their SQL: python tests/compare.py [folder] [name ...]."""

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.datetime, bytes, bytearray)):
        return str(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(folder, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(sql)
    return rows([x[0] for x in r.description], r.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.sql.shuffle.partitions", os.environ.get("PARTS", "8")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or queries:
        t = time.time()
        try:
            got = spark_rows(queries[n](spark, folder))
            if n not in sql:
                print(n, "rows", len(got[1]), f"{time.time() - t:.1f} s")
                continue
            want = oracle(folder, sql[n])
            same = got == want
            print(n, "ok" if same else "DIFFERS", len(got[1]), len(want[1]), f"{time.time() - t:.1f} s")
            if not same:
                bad += 1
                a, b = set(got[1]), set(want[1])
                print("  ", got[0], want[0], "\n   spark only", list(a - b)[:2], "\n   sql only", list(b - a)[:2])
        except Exception as x:
            bad += 1
            print(n, "FAILED", str(x)[:600])
    print("bad:", bad)


if __name__ == "__main__":
    main()
