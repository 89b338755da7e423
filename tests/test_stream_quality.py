"""Quality windows from Spark state against whole windows."""

import random

import numpy as np
from pyspark.sql import functions as F

from kinetrail.streaming import jobs

HOUR = 3_600_000_000


def plain(rows):
    """(key, window) -> (rows, mean, top, bottom, irregular, clipped) of samples (key, us, value)."""
    by = {}
    for k, us, v in rows:
        by.setdefault((k, us // HOUR), []).append((us, v))
    out = {}
    for key, s in by.items():
        s.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
        v = [x[1] for x in s]
        known = [x for x in v if x is not None]
        dt = np.diff([x[0] for x in s]).astype(float)
        clipped, k = 0, 0
        while k < len(v):
            e = k
            while e + 1 < len(v) and v[k] is not None and v[e + 1] == v[k]:
                e += 1
            if e > k and v[k] in (max(known), min(known)):
                clipped += e - k + 1
            k = e + 1
        irregular = bool(len(dt) and dt.mean() > 0 and dt.std() / dt.mean() > 0.2)
        out[key] = (len(s), round(float(np.mean(known)), 9) if known else None, round(float(np.std(known)), 9) if known else None,
                    max(known, default=None), min(known, default=None), irregular, clipped)
    return out


def samples():
    rng = random.Random(6)
    rows = [("hot", k * 7_000_000 + 5, float(rng.choice([0, 1, 2, 3, 3, 3]))) for k in range(1000)]  # a third of all rows, two windows
    rows += [("even", k * 60_000_000, 1.0 if k < 30 else 2.0) for k in range(55)]
    rows += [("flat", rng.randrange(HOUR), 4.0) for _ in range(200)]
    rows += [(f"k{k % 9}", rng.randrange(2 * HOUR), rng.choice([None, 0.0, 1.0, 1.0, 5.0])) for k in range(900)]
    rows += [("ties", 5, float(k % 3)) for k in range(60)] + [("none", 9, None), ("none", 10, None), ("one", 11, 1.0)]
    return [(k, us + 10 * HOUR, v) for k, us, v in rows]


def test_slices_chain_to_whole_windows(spark, tmp_path):
    rows = samples()
    order = sorted(rows, key=lambda r: r[1] + random.Random(str(r)).randrange(HOUR // 2))  # up to half an hour late
    for k in range(3):
        part = order[k * len(order) // 3:(k + 1) * len(order) // 3]
        spark.createDataFrame(part, "key string, us long, value double").select("key", F.timestamp_micros("us").alias("ts"), "value").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", 9_000 * HOUR, 0.0)], "key string, us long, value double").select(
        "key", F.timestamp_micros("us").alias("ts"), "value").write.parquet(str(tmp_path / "last"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for landing in ("in", "last"):
            if landing == "last":
                spark.read.parquet(str(tmp_path / "last")).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(str(tmp_path / "in"))
            jobs.stream_quality(stream, ["key"], "1 hour", "3 hours", slices=8).writeStream.format("parquet").option(
                "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(
                availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.key, int(r.start.timestamp() * 1_000_000) // HOUR): (
        r.rows, None if r["mean"] is None else round(r["mean"], 9), None if r.spread is None else round(r.spread, 9), r.top, r.bottom, r.irregular, r.clipped)
        for r in spark.read.parquet(str(tmp_path / "out")).withColumn("start", F.col("start")).collect() if r.key != "end"}
    assert got == plain(rows)


def test_a_slice_becomes_one_row_of_fixed_width():
    for n in (1, 10, 5000):
        row = jobs.fold_slice([(k, float(k // 3 % 2)) for k in range(n)])
        assert len(row) == len(jobs.SLICE.split(", ")) and all(x is None or isinstance(x, (int, float)) for x in row)
