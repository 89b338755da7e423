"""What grows with the tables: copies of rows, files and joins that a step lays out."""

import math

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from kinetrail.operators import peaks, score, segment, sync, tracks
from kinetrail.plans.blocks import index_series
from kinetrail.plans.scans import band_coefficients, zero_phase_band

KEY = ["key"]


def test_cluster_medians_lay_out_no_row_per_point(spark, monkeypatch):
    """medians of small sets are taken from arrays; parts of a key and large sets agree with them."""
    rng = np.random.default_rng(5)
    shapes = rng.normal(size=(3, 12))
    rows = [(k % 2, k, [float(x) for x in v / np.linalg.norm(v)], 1.0 + k % 3 / 10, float(k), 1.0)
            for k in range(40) for v in [shapes[k % 3] + rng.normal(size=12) / 4]]
    lobes = spark.createDataFrame(rows, "key long, lobe long, shape array<double>, peak double, peak_t double, area double")
    by, real = [], segment.exact_medians
    monkeypatch.setattr(segment, "exact_medians", lambda df, keys, values: by.append(list(keys)) or real(df, keys, values))
    one = sorted(segment.grow_clusters(lobes, KEY, 0.5).collect())
    assert one and not [k for k in by if "_d" in k]
    assert sorted(segment.grow_clusters(lobes, KEY, 0.5, part=4).collect()) == one
    assert [k for k in by if "_d" in k]


def plain_prominence(v, p, pad):
    """The height of row ``p`` over the higher of its two bases; each lies before the first higher row."""
    sides = []
    for way in (v[:p + 1][::-1], v[p:]):
        stop = next((k for k, x in enumerate(way) if x > v[p]), None)
        sides.append(min(way[:stop]) if stop else min(min(way), pad))
    return v[p] - max(sides)


@pytest.mark.parametrize("distance, padded", [(1, False), (3, True)])
def test_bases_end_at_flat_tops_and_at_peaks_thinned_away(small_blocks, distance, padded):
    """5 in 1 5 3 9 9 1 20 ends its way at the flat 9; so it does at a peak removed by its neighbour."""
    rng = np.random.default_rng(11)
    tables = [[1, 5, 3, 9, 9, 1, 20, 2], [4, 4, 1, 3, 0, 7, 7], [0, 3, 2, 2, 2, 6, 1, 8, 0, 9, 4], [1, 1, 1]] + [rng.integers(0, 6, 40).tolist() for _ in range(20)]
    rows = [(k, i, float(x)) for k, v in enumerate(tables) for i, x in enumerate(v)]
    s = index_series(small_blocks.createDataFrame(rows, "key long, t long, x double"), KEY, ["t"])
    got = peaks.find_peaks(s, KEY, "x", distance, padded).collect()
    assert len(got) > 50
    for r in got:
        v = [float(x) for x in tables[r["key"]]]
        assert r["prominence"] == plain_prominence(v, r["i"], 2 * min(v) - max(v) if padded else math.inf), r


def test_triples_of_small_frames_are_laid_out_beside_their_points(spark):
    """one exchange by frame; frames over the bound go by cells and agree."""
    df = spark.range(90).select(F.lit(1).alias("clip_id"), F.floor(F.sqrt("id")).alias("f"), F.col("id").alias("event_id"),
                                (F.col("id") * 7919 % 160).cast("double").alias("y"), (F.col("id") * 104729 % 157).cast("double").alias("x"),
                                ((F.col("id") * 37 % 89) / 89).alias("strength"))
    for build in (tracks.triples, tracks.circles):
        for most in (None, 9):
            got = build(df, max_dets=most)
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
            rows = sorted(got.collect())
            for whole in (8, 0):
                other = sorted(build(df, max_dets=most, whole=whole).collect())
                assert len(rows) == len(other) > 20
                assert all(p[:5] == q[:5] and np.allclose(p[5:], q[5:]) for p, q in zip(rows, other))


def test_captures_of_one_prefix_are_spread(spark):
    """a prefix that all captures share is no single task, and lengths no clip has are not laid out."""
    from kinetrail.sources import pairing

    captures = spark.range(300).select((F.col("id") % 2).alias("dataset"), F.concat(F.lit("/raw/bench_"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".csv")).alias("path"))
    clips = spark.createDataFrame([(0, "/v/bench.mov"), (0, "/v/bench_00.mov"), (1, "/v/squat.mov")], "dataset long, clip_path string")
    seen, real = [], pairing.salted_join
    pairing.salted_join = lambda rows, table, on, by, salts: seen.append((rows, by, salts)) or real(rows, table, on, by, salts)
    try:
        got = {r["path"]: r["clip_path"] for r in pairing.pair_captures(captures, clips).collect()}
    finally:
        pairing.salted_join = real
    want = {f"/raw/bench_{k:04d}.csv": None if k % 2 else "/v/bench_00.mov" if k < 100 else "/v/bench.mov" for k in range(300)}
    assert got == want
    rows, by, salts = seen[0]
    assert rows.count() == 150 * 2 + 150
    assert rows.filter("_pre = 'bench'").groupBy(F.pmod(by, F.lit(salts))).count().agg(F.max("count")).first()[0] < 30


def test_short_keys_are_filtered_together(spark):
    """keys of one block make no call and no join each; batches of any size agree with the plain recursion."""
    from test_operators import naive_zero_phase

    rng = np.random.default_rng(3)
    values = {k: rng.normal(size=n).cumsum() for k, n in enumerate([3, 15, 16, 17, 40, 41, 90, 513])}
    rows = [(k, i, float(x), 40.0 + k) for k, v in values.items() for i, x in enumerate(v)]
    s = index_series(spark.createDataFrame(rows, "key long, t long, x double, fs double"), KEY, ["t"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = zero_phase_band(s, KEY, "x", "y", 0.5, 4.0)
        got = out.toPandas().sort_values(["key", "i"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    for k, v in values.items():
        y = got[got["key"] == k]["y"]
        if len(v) <= 15:
            assert y.isna().all() and len(y) == len(v)
        else:
            assert np.allclose(y, naive_zero_phase(*band_coefficients(0.5, 4.0, 40.0 + k), v), atol=1e-8)


@pytest.mark.parametrize("rows", [16, 65536])
def test_lags_of_short_keys_are_found_together(spark, rows):
    """no call per key; keys that only one side has are left out; blocks do not change the answer."""
    spark.conf.set("kinetrail.blockRows", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = np.random.default_rng(4)
        x = {k: rng.normal(size=30 + 20 * k) for k in range(4)}
        y = {k: np.roll(v, 2) + rng.normal(size=len(v)) / 5 for k, v in x.items() if k}
        a, b = (spark.createDataFrame([(k, g, float(z)) for k, v in side.items() for g, z in enumerate(v) if g % 7], "key long, k long, v double") for side in (x, y))
        out = sync.lag_curve(a, b, KEY, "v", "v", 3, need=5)
        got = {(r["key"], r["lag"]): (r["points"], r["corr"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("kinetrail.blockRows")
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(got) == {(k, lag) for k in y for lag in range(-3, 4)}
    for (k, lag), (points, corr) in got.items():
        at = [g for g in range(len(x[k])) if g % 7 and 0 <= g + lag < len(x[k]) and (g + lag) % 7]
        assert points == len(at) and np.isclose(corr, np.corrcoef(x[k][at], y[k][np.array(at) + lag])[0, 1])


def test_means_of_few_reps_go_to_one_salt(spark, monkeypatch):
    """a mean is not copied to salts that no rep of its key takes; many reps of a key still take several."""
    rows = [(k, rep, g, float(rep * g % 7), float(g), float(rep % 5)) for k, reps in ((1, 5), (2, 200)) for rep in range(reps) for g in range(4)]
    grid = spark.createDataFrame(rows, "key long, rep long, g long, x double, y double, z double")
    joined, real = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, *a, **kw: joined.append(other) or real(self, other, *a, **kw))
    lengths = grid.filter("g = 0").select("key", "rep", (F.col("rep") % 9 + 1.0).alias("duration"))
    got = {r["key"]: r for r in score.dispersion(grid, lengths, KEY, ("x", "y", "z")).collect()}
    assert {r["key"]: r["count"] for r in joined[0].groupBy("key").count().collect()} == {1: 4, 2: 4 * 4}
    for k, reps in ((1, 5), (2, 200)):
        v = np.array([r[3:] for r in rows if r[0] == k]).reshape(reps, 4, 3)
        d = v - v.mean(axis=0)
        h = np.hypot(d[..., 0], d[..., 1])
        assert got[k]["n_reps"] == reps and got[k]["worst_rep"] in np.flatnonzero(np.isclose(h.mean(1), h.mean(1).max()))
        assert np.isclose(got[k]["horizontal_rms"], 100 * np.sqrt((h**2).mean())) and np.isclose(got[k]["rms_z"], 100 * d[..., 2].std())
        assert np.isclose(got[k]["horizontal_p95"], 100 * np.quantile(h, 0.95))


@pytest.mark.parametrize("similarity", [0.3, 0.6])
def test_clusters_of_short_keys_take_one_exchange(spark, similarity):
    """lobes of short keys are not written and dealt anew every round; rows with gaps and ties end as on the long way."""
    rng = np.random.default_rng(8)
    rows = []
    for key in range(12):
        base = rng.normal(size=(3, 10))
        for lobe in range([1, 2, 5, 9, 14, 3][key % 6]):
            v = base[rng.integers(3)] + rng.normal(size=10) / 3 * (key % 3)
            shape = [float(x) for x in v / np.linalg.norm(v)]
            if key > 8 and lobe == 2:
                shape[4] = None if key == 9 else math.nan
            rows.append((key if key != 5 else None, 7 * lobe + 3, shape, [1.0, 1.2, 3.1, None][rng.integers(4 if key > 7 else 3)],
                         None if key == 10 and lobe == 1 else float(lobe), None if key == 6 else float(rng.integers(3) - 1)))
    lobes = spark.createDataFrame(rows, "key long, lobe long, shape array<double>, peak double, peak_t double, area double").repartition(5)
    out = segment.grow_clusters(lobes, KEY, similarity)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "Join" not in plan
    got = sorted(out.collect())
    assert len({r["key"] for r in got}) > 9 and None not in {r["key"] for r in got}
    assert got == sorted(segment._grow_long(segment.settle(lobes), KEY, similarity, 2.5, 6, 3).collect())
    assert got == sorted(segment.grow_clusters(lobes, KEY, similarity, part=4).collect())
