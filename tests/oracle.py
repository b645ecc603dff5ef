"""Compares queries with their oracles: ``python tests/oracle.py sf_dir [name ...]``."""

import datetime
import decimal
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con, sql):
    """None when equal, else what differs."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine[1] else "no rows"
    cur = con.execute(sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"first difference\n  spark {str(a)[:600]}\n  duck  {str(b)[:600]}"
    return None if mine[1] else "no rows"


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("sheaf").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    from __spark_entry__ import oracle_sql, queries

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = session(), duck(folder), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            diff = compare(build(spark, folder), con, oracle_sql().get(name))
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}" if not names else traceback.format_exc()[-3000:]
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.2f}s {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
