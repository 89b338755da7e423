"""Objective, search and transfer on recordings with a planted error."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import fit, score, whatif
from kinetrail.plans.blocks import index_series, settle

KEYS = ["capture_id"]
BIAS = ("bias_x", 0.0, 0.0)


def recording(spark, planted):
    """Captures of four lifts along x; the sensor reads too little by ``planted``; the referee sees the true path."""
    rows, seen = [], []
    for c, b in planted.items():
        for i in range(400):
            t = i * 0.02
            rows.append((c, i, t, 0.02, -0.4 * (math.pi * 1.0) ** 2 * math.cos(math.pi * t) - b, 0.3 * math.sin(5 * t), 0.0))
            seen.append((c, t, 0.4 * math.cos(math.pi * t)))
    s = spark.createDataFrame(rows, "capture_id long, k long, t double, dt double, ax double, ay double, az double").withColumns(
        {"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)})
    series = settle(index_series(s, KEYS, ["k"]).drop("k"))
    reps = spark.createDataFrame([(c, r, r * 100, r * 100 + 101) for c in planted for r in range(3)], "capture_id long, rep long, start_i long, stop_i long")
    return series, reps, spark.createDataFrame(seen, "capture_id long, t double, x double")


def test_search_finds_a_planted_bias(spark):
    series, reps, track = recording(spark, {1: 0.11, 2: -0.07, 3: 0.0})
    got = {r.capture_id: r for r in fit.bracket_search(
        settle(fit.with_referee(series, track, KEYS)), reps, KEYS, {"bias_x": (0.0, 0.2)}, {"bias": BIAS}, rounds=3, bias_frame=None).collect()}
    for c, b in {1: 0.11, 2: -0.07, 3: 0.0}.items():
        assert got[c].bias_x == pytest.approx(b, abs=0.05) and got[c].h_rms <= got[c].start_h_rms and got[c].n_compared == 3
    assert got[1].h_rms < got[1].start_h_rms / 2 and got[3].h_rms == pytest.approx(got[3].start_h_rms)


def test_unusable_is_infinite_and_transfer_survives_it(spark):
    series, reps, track = recording(spark, {1: 0.05, 2: 0.05, 3: 0.05})
    grid = whatif.parameter_grid(spark, {"bias_x": [0.0, 0.05]})
    seen = settle(fit.with_referee(series, track.filter("capture_id < 3"), KEYS))
    each = [*KEYS, "param_id"]
    rebuilt = whatif.rebuild(settle(whatif.with_params(seen, grid)), each, {"bias": BIAS}, bias_frame=None)
    scores = settle(fit.objective(rebuilt, whatif.with_params(reps, grid.select("param_id")), each))
    by = {(r.capture_id, r.param_id): r.h_rms for r in scores.collect()}
    assert by[3, 0] == math.inf and by[1, 1] < by[1, 0] < math.inf
    assert {(r.capture_id, r.param_id) for r in whatif.transfer(scores, "capture_id").collect()} == {(1, 1), (2, 1), (3, 1)}
    assert fit.objective(rebuilt.limit(0), whatif.with_params(reps, grid.select("param_id")), each).count() == 0


def test_objective_is_the_score_against_the_track(spark):
    """The moment form equals the rms of the curves that the full comparison gives."""
    series, reps, track = recording(spark, {1: 0.05, 2: -0.1})
    moved = whatif.rebuild(series, KEYS, {}, bias_frame=None).withColumns({"bx": F.col("px"), "by": F.col("py"), "bz": F.col("pz")})
    from kinetrail.operators.correct import detrend

    live = score.against_track(settle(detrend(moved, reps, KEYS)), track.withColumn("height", F.lit(0.0)), KEYS)[2]
    per = {}
    for r in live.collect():
        per.setdefault((r.capture_id, r.rep), []).append((r.pipe_u - r.ref_u) ** 2)
    want = {c: float(np.median([np.sqrt(np.mean(v)) * 100 for (k, _), v in per.items() if k == c])) for c in (1, 2)}
    got = fit.objective(whatif.rebuild(fit.with_referee(series, track, KEYS), KEYS, {}, bias_frame=None), reps, KEYS)
    assert {r.capture_id: r.h_rms for r in got.collect()} == pytest.approx(want, rel=1e-9)


def test_fixed_points_against_all_permutations(spark):
    from itertools import permutations

    from kinetrail.operators.studies import fixed_points_tail

    rows = [(n, k) for n in range(1, 7) for k in range(n + 1)] + [(5000, 0), (5000, 3), (300, 250)]
    got = {(r.n, r.k): r.p for r in spark.createDataFrame(rows, "n long, k long").withColumn("p", fixed_points_tail(F.col("n"), F.col("k"))).collect()}
    for n in range(1, 7):
        fixed = [sum(a == b for a, b in enumerate(p)) for p in permutations(range(n))]
        for k in range(n + 1):
            assert got[n, k] == pytest.approx(sum(x >= k for x in fixed) / len(fixed), abs=1e-12)
    assert got[5000, 0] == pytest.approx(1) and got[5000, 3] == pytest.approx(1 - 2.5 / math.e) and got[300, 250] < 1e-300
