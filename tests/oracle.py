"""Run registered queries beside their SQL: python -m tests.oracle [sf_dir] [name ...]."""

import datetime
import sys

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    want = rows_of(columns, want.fetchall())
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    same = sorted(df.columns) == sorted(columns) and got == want
    return same, next(((g, w) for g, w in zip(got, want) if g != w), (len(got), len(want), df.columns, columns))


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config(
        "spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) <= 2 or name in sys.argv[2:]:
            try:
                same, first = compare(spark, sf_dir, name, entry.queries()[name], sql)
                print("ok  " if same else "DIFF", name, "" if same else first, flush=True)
            except Exception as error:
                print("FAIL", name, str(error)[:300], flush=True)
