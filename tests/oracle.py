"""Compare a query's rows with its SQL's in DuckDB: python tests/oracle.py [sf] [names]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

DATA = os.environ.get("ORACLE_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        x = float(x)
        return round(x, 9) if math.isfinite(x) else x
    return str(x) if type(x).__name__ in ("date", "datetime", "Timestamp") else x


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf: str, f, sql: str) -> str:
    """Empty if both give the same rows."""
    df = f(spark, f"{DATA}/{sf}")
    mine = rows(df.columns, df.collect())
    got = con.execute(sql)
    theirs_names = [c[0] for c in got.description]
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} and {sorted(theirs_names)}"
    theirs = rows(theirs_names, got.fetchall())
    if mine == theirs:
        return "" if sum(mine.values()) else "no rows on either side"
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:2]}, only there {list((theirs - mine).items())[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = (sys.argv[1:2] or ["sf0.01"])[0], sys.argv[2:]
    con, queries, sql = duck(sf), entry.queries(), entry.oracle_sql()
    for name in names or sql:
        began = time.time()
        try:
            said = compare(spark, con, sf, queries[name], sql[name]) if name in sql else f"{queries[name](spark, f'{DATA}/{sf}').count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if not said else 'BAD'} {name} {time.time() - began:.1f}s {said[:900]}", flush=True)
