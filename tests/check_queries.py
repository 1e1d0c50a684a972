"""Run every registered query against its SQL: python tests/check_queries.py [folder] [names...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b


def compare(spark, folder, name, query, sql):
    import duckdb

    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"{len(got)} rows, no SQL"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {frame.columns} != {columns}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    return f"VALUES {len(bad)} differ: {bad[:3]}" if bad else f"ok {len(got)}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    partitions, zone = os.environ.get("PARTITIONS", "8"), os.environ.get("ZONE", "UTC")
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.sql.session.timeZone", zone).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sqls = E.oracle_sql()
    for name, query in E.queries().items():
        if name not in sqls:
            continue
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        print(f"{name:28s} {compare(spark, folder, name, query, sqls.get(name))}"
              f"  {time.time() - start:.1f}s", flush=True)
