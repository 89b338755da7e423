"""Run registered queries against their SQL in DuckDB.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(canon(r[k]) for k in order) for r in rows)


def compare(spark, con, name, query, sf_dir):
    """(ok, message, seconds)"""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if query.sql is None:
        return len(got) >= 0, f"rows only: {len(got)}", took
    rel = con.execute(query.sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows", took
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    diff = len(set(a) ^ set(b))
    return False, f"rows {len(a)} vs {len(b)}, {diff} differ; cols {sorted(names)}\n   spark {only_a}\n   duck  {only_b}", took


def session(block_rows: int | None = None):
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").appName("kinetrail-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1"))
    if block_rows:
        b = b.config("kinetrail.blockRows", str(block_rows))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from kinetrail.catalog import load
    from kinetrail.catalog.base import CATALOG

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    load()
    spark, con = session(int(os.environ["BLOCK"]) if "BLOCK" in os.environ else None), connect(sf)
    bad = 0
    for name, q in CATALOG.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg, took = compare(spark, con, name, q, sf)
        except Exception as e:  # report and go on
            ok, msg, took = False, "ERROR " + str(e)[:int(os.environ.get("ERR", "1500"))], 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        if not ok or not os.environ.get("QUIET"):
            print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {took:6.2f}s {msg}", flush=True)
    print(f"{bad} failed")
