"""Results must not depend on the order in which equal numbers were added, nor on a second evaluation."""

import math
import random

from pyspark.sql import functions as F

from kinetrail.operators import tracks, windows
from kinetrail.plans.blocks import index_series
from kinetrail.plans.quantiles import exact_medians, exact_quantiles

KEY = ["key"]


def cycle(spark, rows=15):
    """Five values over and over: all windows of five rows hold the same numbers, each in another order."""
    values = [0.1, 0.2, 0.3, 0.5, 0.7]
    df = spark.createDataFrame([(key, k * 0.2, values[(key + k) % 5] * (1 + key / 7)) for key in range(20) for k in range(rows)], "key long, t double, x double")
    return index_series(df, KEY, ["t"]).withColumn("fs", F.lit(5.0))


def test_medians_of_values_that_come_out_anew(spark):
    """a value computed twice may differ in its last bits."""
    new = F.udf(lambda k: 1.0 + random.random() * 1e-12, "double").asNondeterministic()
    df = spark.range(40).select((F.col("id") % 8).alias("key"), new("id").alias("v"))
    got = exact_medians(df, KEY, {"m": "v"}).collect()
    assert len(got) == 8 and all(abs(r["m"] - 1.0) < 1e-9 for r in got)


def test_small_and_large_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, 1).when(F.col("id") < 2990, 2).alias("key"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    rows = df.toPandas()
    for whole in (10, 500, 5000):
        got = {r["key"]: r for r in exact_quantiles(df, KEY, {"a": ("v", 0.5), "b": ("v", 0.95)}, whole=whole).collect()}
        assert set(got) == {1, 2, None}
        for key, r in got.items():
            v = rows["v"][rows["key"].isna() if key is None else rows["key"] == key]
            assert abs(r["a"] - v.quantile(0.5)) < 1e-9 and abs(r["b"] - v.quantile(0.95)) < 1e-9


def test_stillest_window_is_the_earliest_of_equal_ones(spark):
    """F10 to F13, F18."""
    got = windows.stillest_window(cycle(spark), KEY, value=F.col("x")).collect()
    assert {r["start_i"] for r in got} == {0}


def test_quietest_slide_is_the_earliest_of_equal_ones(spark):
    """F14, F19."""
    got = windows.quietest_slide(cycle(spark, 40), KEY, F.col("x"), span_s=1.0, slide_s=0.2, least=5).collect()
    assert {r["start_t"] for r in got} == {0.0}


def test_median_at_its_bound(spark):
    """0.44 and 0.46 have the median 0.45, however it is computed."""
    pairs = [(k, k / 1000, (900 - k) / 1000) for k in range(300, 450)]
    rows = [(k, float(j), float(j), s, 0.001 * s, 0.001, 2) for k, a, b in pairs for j, s in enumerate((a, b))]
    t = spark.createDataFrame(rows, "clip_id long, t double, height double, score double, residual_px double, m_per_px_t double, n_markers int")
    t = index_series(t.withColumn("height", F.lit(1.0) + F.col("height")), ["clip_id"], ["t"])
    got = tracks.template_findings(t, ["clip_id"], 0.5, 0.45).collect()
    assert not [r["clip_id"] for r in got if "low_score" in r["findings"]]


def test_close_points_are_not_broadcast(spark):
    """cells around a point are guessed small from the compressed file and once filled the driver."""
    df = spark.range(64).select(F.lit(1).alias("clip_id"), F.floor(F.col("id") / 8).alias("f"), F.col("id").alias("event_id"),
                                (F.col("id") * 37 % 160).cast("double").alias("y"), (F.col("id") * 59 % 160).cast("double").alias("x"), F.rand(1).alias("strength"))
    plan = tracks.merge_close_points(df, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_lever_sweep_copies_no_sample_per_direction(spark):
    """the rows before the fold to reps do not grow with the directions."""
    from kinetrail.operators import whatif

    rows = [(1, j * 0.1, math.cos(j * 0.05), 0.6 * math.sin(j * 0.05), 0.0, 0.8 * math.sin(j * 0.05)) for j in range(30)]
    s = index_series(spark.createDataFrame(rows, "key long, t double, qw double, qx double, qy double, qz double"), KEY, ["t"])
    reps = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "key long, rep long, start_i long, stop_i long")
    got = whatif.lever_sweep(s, reps, KEY, whatif.fibonacci_directions(spark, 12)).collect()
    assert len(got) == 12 and all(0 < r["sweep"] < 0.14 for r in got)
    seen = []
    real, whatif.detrend = whatif.detrend, lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
    try:
        whatif.lever_sweep(s, reps, KEY, whatif.fibonacci_directions(spark, 12))
    finally:
        whatif.detrend = real
    assert seen[0].count() == 20
