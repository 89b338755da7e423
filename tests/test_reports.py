"""Report tables on small cases with known answers."""

import statistics

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import motion, reports
from kinetrail.plans.blocks import index_series, settle

KEYS = ["capture_id"]


def test_bias_variants_remove_a_planted_constant(small_blocks):
    spark = small_blocks
    # a body that starts at rest and stays there; the sensor of capture c reads c too much along x
    rows = [(c, k, k * 0.05 + (0.01 if k % 2 else 0.0), float(c), 0.0) for c in (0, 1, 2) for k in range(60)]
    s = settle(index_series(spark.createDataFrame(rows, "capture_id long, k long, t double, ax double, ay double"), KEYS, ["k"]))
    x = motion.double_integral(motion.spacing(s, KEYS), KEYS, ("ax", "ay"), ("vx", "vy"), ("px", "py"))
    reps = spark.createDataFrame([(c, r, r * 20, r * 20 + 20) for c in (0, 1, 2) for r in range(3)], "capture_id long, rep long, start_i long, stop_i long")
    rests = spark.createDataFrame([(c, 0, 30) for c in (0, 1)], "capture_id long, start_i long, stop_i long")
    got = {r.capture_id: r for r in reports.bias_variants(x, reps, rests, KEYS, ("ax", "ay"), ("vx", "vy"), ("px", "py")).collect()}
    t = [r[2] for r in rows[:60]]
    drift = statistics.median((t[r * 20 + 19] - t[r * 20]) ** 2 / 2 for r in range(3))
    for c in (0, 1, 2):
        assert got[c].reps_ == 3 and got[c]["none"] == pytest.approx(c * drift)
        assert got[c].rep_mean == pytest.approx(0, abs=1e-9) and got[c].closure == pytest.approx(0, abs=1e-9)
    assert got[1].rest_mean == pytest.approx(0, abs=1e-9)
    assert got[2].rest_mean == pytest.approx(2 * drift)  # without rests nothing is known


def test_closure_groups(spark):
    rows = [(n % 7, n, float(n * 37 % 101) - 50, 0.5 + n % 3, n % 2 == 0) for n in range(400)]
    df = spark.createDataFrame(rows, "capture_id long, start_i long, dv double, duration_s double, spans_impact boolean")
    kind = F.when(F.col("capture_id") < 3, "one").when(F.col("capture_id") < 6, "two")
    got = {(r.kind, r.part): r for r in reports.closure_groups(df, kind, ("two",), ("capture_id", "start_i")).collect()}
    own = {("one", "lifting"): [r for r in rows if r[0] < 3], ("two", reports.PULL): [r for r in rows if 3 <= r[0] < 6 and not r[4]],
           ("two", reports.IMPACT): [r for r in rows if 3 <= r[0] < 6 and r[4]]}
    whole = {("one", None): own["one", "lifting"], ("two", None): [r for r in rows if 3 <= r[0] < 6], (None, None): [r for r in rows if r[0] < 6]}
    assert set(got) == set(own) | set(whole)
    for key, members in (own | whole).items():
        dv = [r[2] for r in members]
        assert got[key].intervals == len(members) and got[key].mean_dv == pytest.approx(statistics.mean(dv))
        assert got[key].rms_dv == pytest.approx(statistics.mean(v * v for v in dv) ** 0.5)
        if key in own:
            m = statistics.median(dv)
            assert got[key].median_dv == pytest.approx(m)
            assert (got[key].shown_capture_id, got[key].shown_start_i) == min((round(abs(r[2] - m), 6), r[0], r[1]) for r in members)[1:]
    assert reports.closure_groups(df.limit(0), kind, ("two",), ("capture_id", "start_i")).filter("kind is not null").count() == 0


def test_two_anchors_and_ranges_keep_what_one_side_lacks(spark):
    holds = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, 1.5)], "capture_id long, open_deg double, close_deg double")
    residuals = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.3), (3, 0, 0.5)], "capture_id long, rep long, residual double")
    got = {r.capture_id: (r.open_deg, r.rep_residual) for r in reports.two_anchors(holds, residuals, KEYS).collect()}
    assert got == {1: (2.0, pytest.approx(0.2)), 2: (1.0, None), 3: (None, 0.5)}
    a = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6)], "capture_id long, rep long, rom double")
    b = spark.createDataFrame([(1, 0, 0.4), (2, 0, 0.9)], "capture_id long, rep long, rom double")
    wide = {(r.capture_id, r.rep): (r.log, r.track, r.log_off) for r in reports.paired_ranges({"log": a, "track": b}, ["capture_id", "rep"], "track").collect()}
    assert wide == {(1, 0): (0.5, 0.4, pytest.approx(0.1)), (1, 1): (0.6, None, None), (2, 0): (None, 0.9, None)}
