"""calls between Python and the state of stream_quality go by bucket of keys, not by key."""

import random

import numpy as np
from pyspark.sql import functions as F

from kinetrail.streaming import jobs
from test_stream_quality import HOUR, plain


def test_many_keys_fold_as_each_alone():
    rng = random.Random(1)
    rows = [(k % 40, rng.randrange(60), rng.choice([None, 0.0, -1.0, 1.0, 1.0, 3.0])) for k in range(900)] + [(40, 7, None), (41, 7, 2.0)]
    key, us, v = zip(*rows)
    got = jobs.fold_slices(np.array(key), np.array(us), np.array([np.nan if x is None else x for x in v]))
    assert list(got) == [f.split()[0] for f in jobs.SLICE.split(", ")]
    for k in range(42):
        one = [None if c[k] != c[k] else c[k] for c in got.values()]
        mine = sorted([r[1:] for r in rows if r[0] == k], key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
        known = [x for _, x in mine if x is not None]
        assert one[0] == len(mine) and one[1] == len(known)
        assert np.allclose([one[2], one[3]], [sum(known), len(known) * np.var(known) if known else 0.0])
        assert one[4:8] == [max(known, default=None), min(known, default=None), mine[0][0], mine[-1][0]]
        runs = []
        for _, x in mine:
            if runs and x is not None and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        dt = np.diff([u for u, _ in mine])
        assert one[8:15] == [dt.sum(), (dt * dt).sum(), *runs[0], *runs[-1], len(runs)]
        assert one[15:] == [sum(n for x, n in runs[1:-1] if n > 1 and x == e) if known else 0 for e in (one[4], one[5])]
        assert jobs.fold_slice([(u, x) for _, u, x in rows if _ == k])[:3] == tuple(one[:3])


def test_state_goes_by_bucket_and_keys_stay_exact(spark, tmp_path):
    odd = [None, 2**53 + 1, 2**53 + 2, -5]  # as doubles two of them are one
    rows = [(odd[k] if k < 4 else k, "a\nb" if k % 2 else "", 10 * HOUR + 1000 * (k % 7) + m, float(m % 3)) for k in range(400) for m in range(3)]
    schema = "key long, part string, us long, value double"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = []
    try:
        for _ in range(2):
            stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(str(tmp_path / "in"))
            run = jobs.stream_quality(stream, ["key", "part"], "1 hour", "3 hours", slices=4, buckets=5).writeStream.format("parquet").option(
                "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            # one of the two operators holds samples
            held += [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators if "transformWithState" in o.operatorName]
            spark.createDataFrame([(7, "", 9_000 * HOUR, 0.0)], schema).withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {((r.key, r.part), int(r.start.timestamp() * 1_000_000) // HOUR): (
        r.rows, round(r["mean"], 9), round(r.spread, 9), r.top, r.bottom, r.irregular, r.clipped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain([((k, p), us, v) for k, p, us, v in rows])
    assert held and 0 < max(held) < 200  # by key there were 400 timers and a row a sample
