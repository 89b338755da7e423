"""Peaks, alignment, closeness measures, what-if sweeps and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import CLIP, KEY, query, reps, samples, table, track
from kinetrail.catalog.events import _PICK, clock, picked
from kinetrail.catalog.repeats import (
    _M5, _DET, _IMP, _P3, _V3, AXES, STILL, bounds, grid_rows, integrated, lifted, marks, paths, scored, XYZ,
)
from kinetrail.operators import correct, motion, peaks, score, studies, sync, whatif, windows
from kinetrail.operators.motion import POSITION, WORLD
from kinetrail.plans.blocks import BLOCK, lookup, per_key, settle
from kinetrail.plans.joins import interval_join
from kinetrail.plans.quantiles import exact_medians


@query("w10_prominent_peaks", "capture_id i", "peak prominence", """
  WITH y AS (SELECT capture_id, i, n, value AS v, lag(value) OVER w AS l, lead(value) OVER w AS r FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  p AS (SELECT capture_id, i, n, v FROM y WHERE v > l AND v > r),
  b AS (SELECT p.*, coalesce((SELECT max(i) FROM samples s WHERE s.capture_id = p.capture_id AND s.i < p.i AND s.value > p.v), -1) AS lo,
    coalesce((SELECT min(i) FROM samples s WHERE s.capture_id = p.capture_id AND s.i > p.i AND s.value > p.v), p.n) AS hi FROM p)
  SELECT capture_id, i, v AS peak, v - greatest((SELECT min(value) FROM samples s WHERE s.capture_id = b.capture_id AND s.i > lo AND s.i <= b.i),
    (SELECT min(value) FROM samples s WHERE s.capture_id = b.capture_id AND s.i >= b.i AND s.i < hi)) AS prominence FROM b""", "samples")
def _(spark, d):
    return peaks.find_peaks(samples(spark, d), KEY, "value")


@query("w10_distant_peaks", "capture_id i", "peak prominence")
def _(spark, d):
    return peaks.find_peaks(samples(spark, d), KEY, "value", distance=5, padded=True)


@query("g11_track_reps", "clip_id rep start_i stop_i")
def _(spark, d):
    t = track(spark, d)
    want = t.groupBy(*CLIP).agg(F.max(F.when(F.col("clip_id") % 3 != 0, F.lit(3) + F.col("clip_id") % 2)).alias("expected_reps"))
    return peaks.track_reps(t, want, CLIP, fps=5.0)


@query("g12_own_range", "clip_id rep", "trough own_range")
def _(spark, d):
    return peaks.own_range(track(spark, d), CLIP, "height", 0.15, 2)


# ------------------------------------------------------------- alignment -----


def lagged(spark, d):
    s = samples(spark, d).withColumns({"b": F.col("ay") + F.col("ax") / 3})
    return settle(sync.lag_curve(s, s, KEY, "ax", "b", 20, grid="i", need=30).filter("corr is not null"))


@query("m27_sidelobe_ratio", "capture_id lag", "corr sidelobe", """
  WITH c AS (SELECT x.capture_id, l.lag, corr(x.ax, y.ay + y.ax/3) AS c FROM samples x, (SELECT unnest(range(-20, 21)) AS lag) l
    JOIN samples y ON y.capture_id = x.capture_id AND y.i = x.i + l.lag GROUP BY 1, 2 HAVING count(*) >= 30),
  p AS (SELECT capture_id, arg_max(lag, c) AS pk, max(c) AS pc FROM c GROUP BY 1),
  n AS (SELECT a.*, l.c AS lc, r.c AS rc FROM c a JOIN c l ON l.capture_id = a.capture_id AND l.lag = a.lag - 1 JOIN c r ON r.capture_id = a.capture_id AND r.lag = a.lag + 1)
  SELECT p.capture_id, pk AS lag, pc AS corr, max(n.c)/max(pc) AS sidelobe FROM p LEFT JOIN n ON n.capture_id = p.capture_id AND abs(n.lag - pk) > 4 AND n.c >= lc AND n.c >= rc GROUP BY p.capture_id, pk, pc""", "samples", places=3)
def _(spark, d):
    return sync.sidelobe_ratio(lagged(spark, d), KEY, 10.0)


@query("m4_lag_policy", "capture_id rivals stray refusal", "offset corr half_s")
def _(spark, d):
    curve = lagged(spark, d)
    cadence = curve.groupBy(*KEY).agg(F.lit(0.4).alias("cadence_s"), F.lit(2.0).alias("reach_s"))
    return sync.lag_policy(curve, cadence, KEY, rate=10.0, start_s=1.0)


@query("m3_common_clock", "capture_id lag points", "corr", places=2)
def _(spark, d):
    # both motions resampled, filtered and compared on one grid
    trk = track(spark, d).withColumnRenamed("clip_id", "capture_id")
    s = samples(spark, d).withColumn("vz", F.col("value") / 100)
    a, b = sync.motion_signals(trk.select(*KEY, "i", "n", BLOCK, "t", "height"), s, KEY, rate=25.0)
    curve = sync.lag_curve(a, b, KEY, "signal", "signal", 50, need=100)
    return curve.filter("corr is not null")


@query("u3_resample_grid", "capture_id k", "value", """
  WITH e AS (SELECT capture_id, i, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2, min(t) OVER k AS t0 FROM samples
    WINDOW w AS (PARTITION BY capture_id ORDER BY i), k AS (PARTITION BY capture_id))
  SELECT capture_id, k, value + (v2 - value)*(k/7.0 - t)/(t2 - t) AS value FROM e, (SELECT unnest(range(0, 120)) AS k) WHERE t2 > t AND k/7.0 >= t - 1e-9 AND k/7.0 < t2 - 1e-9""", "samples", places=3)
def _(spark, d):
    return sync.uniform_grid(samples(spark, d), KEY, ["value"], 7.0)


# ------------------------------------------------------ closeness measures ---


def instants(spark, d):
    return picked(spark, d).select(*KEY, F.col("t").alias("at"))


@query("m10_range_around_events", "capture_id", "at_t range_", f"""
  WITH RECURSIVE {_PICK} SELECT p.capture_id, p.t AS at_t, max(s.ax) - min(s.ax) AS range_ FROM picked p JOIN samples s ON s.capture_id = p.capture_id
    AND s.t > p.t - 0.3 AND s.t < p.t + 0.3 GROUP BY 1, 2""", "samples")
def _(spark, d):
    return studies.range_in_window(samples(spark, d), instants(spark, d), KEY, "ax", 0.3, "range_").withColumnRenamed("at", "at_t")


@query("m11_tiled_residual", "capture_id", "residual", """
  WITH x AS (SELECT s.*, floor((t - 1.0)/2.0) AS tile, max(t) OVER (PARTITION BY capture_id) AS te FROM samples s),
  y AS (SELECT * FROM x WHERE tile >= 0 AND 1.0 + tile*2.0 < te - 2.0), f AS (SELECT capture_id, tile, regr_slope(ax, t) AS s, regr_intercept(ax, t) AS c FROM y GROUP BY 1, 2)
  SELECT capture_id, median(m) AS residual FROM (SELECT capture_id, tile, max(abs(ax - coalesce(s*t + c, ax))) AS m FROM y JOIN f USING (capture_id, tile) GROUP BY 1, 2) GROUP BY 1""", "samples", places=3)
def _(spark, d):
    return studies.tiled_line_residual(samples(spark, d), KEY, ["ax"], 1.0, 2.0)


@query("m14_rep_identification", "capture_id rep nearest identified", "distance", f"""
  WITH {_DET}, v AS (SELECT capture_id, rep, list(x ORDER BY j) AS a, list(y ORDER BY j) AS b FROM det GROUP BY 1, 2),
  d AS (SELECT p.capture_id, p.rep, q.rep AS other, list_distance(p.a, q.b) AS d FROM v p JOIN v q USING (capture_id))
  SELECT capture_id, rep, arg_min(other, struct_pack(d := d, o := other)) AS nearest, arg_min(other, struct_pack(d := d, o := other)) = rep AS identified, min(d) AS distance FROM d GROUP BY 1, 2""", "samples reps", places=3)
def _(spark, d):
    p = settle(paths(spark, d))
    def curve(c):
        return p.groupBy(*KEY, "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", c))), lambda e: e[c]).alias("v"))
    return studies.rep_identification(curve("x"), curve("y"), KEY, "v")


@query("m18_event_phase", "capture_id rep inside exactly_one", "phase", f"""
  WITH RECURSIVE {_PICK}, w AS (SELECT r.capture_id, r.rep, min(t) AS t0, max(t) AS t1 FROM reps r JOIN samples s ON s.capture_id = r.capture_id AND s.i >= start_i AND s.i < stop_i GROUP BY 1, 2)
  SELECT w.capture_id, w.rep, count(p.i) AS inside, count(p.i) = 1 AS exactly_one, min((p.t - t0)/(t1 - t0)) AS phase FROM w LEFT JOIN picked p
    ON p.capture_id = w.capture_id AND p.t >= t0 AND p.t <= t1 GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    ends = interval_join(samples(spark, d).drop("n"), bounds(spark, d), KEY).groupBy(*KEY, "rep").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return studies.phase_in_window(picked(spark, d), ends, KEY, 2.0)


@query("m19_position_between", "capture_id", "t share", f"""
  WITH RECURSIVE {_PICK}, {_IMP}, im AS (SELECT imp.capture_id, s.t FROM imp JOIN samples s ON s.capture_id = imp.capture_id AND s.i = imp.i)
  SELECT p.capture_id, p.t, (p.t - a.t)/(b.t - a.t) AS share FROM picked p ASOF JOIN im a ON a.capture_id = p.capture_id AND p.t > a.t
    ASOF JOIN im b ON b.capture_id = p.capture_id AND p.t < b.t""", "samples")
def _(spark, d):
    return studies.position_between(picked(spark, d), marks(spark, d), KEY)


@query("m20_window_changes", "capture_id windows", "corr", """
  WITH g AS (SELECT capture_id, i, n, t, gx, sum(s) OVER w AS c FROM (SELECT *, coalesce((ax + lag(ax) OVER w)/2*(t - lag(t) OVER w), 0) AS s FROM samples
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  d AS (SELECT capture_id, i, n, lead(c, 5) OVER w - c AS dv, lead(gx, 6) OVER w - gx AS dr FROM g WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  SELECT capture_id, count(*) AS windows, corr(dv, dr) AS corr FROM d WHERE i % 2 = 0 AND i < n - 6 GROUP BY 1""", "samples")
def _(spark, d):
    return studies.window_change_corr(samples(spark, d), KEY, "ax", "gx", 6, 2)


@query("m21_up_down_balance", "capture_id rep balanced", "up down", """
  WITH s AS (SELECT r.capture_id, r.rep, s.i, s.start_ok, (greatest(ay,0)+greatest(pa,0))/2*dtt AS u, (least(ay,0)+least(pa,0))/2*dtt AS v FROM reps r JOIN (
      SELECT *, true AS start_ok, lag(ay) OVER w AS pa, t - lag(t) OVER w AS dtt FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i)) s
    ON s.capture_id = r.capture_id AND s.i > r.start_i AND s.i < r.stop_i),
  a AS (SELECT capture_id, rep, sum(u) AS up, abs(sum(v)) AS down FROM s GROUP BY 1, 2)
  SELECT *, least(up, down) > 0.3*greatest(up, down) AS balanced FROM a""", "samples reps")
def _(spark, d):
    return studies.up_down_balance(samples(spark, d), bounds(spark, d), KEY, "ay")


@query("m22_step_around_events", "capture_id", "at_t step", f"""
  WITH RECURSIVE {_PICK} SELECT p.capture_id, p.t AS at_t, b.ax - a.ax AS step FROM picked p
    ASOF JOIN samples a ON a.capture_id = p.capture_id AND p.t - 0.15 <= a.t ASOF JOIN samples b ON b.capture_id = p.capture_id AND p.t + 0.35 <= b.t
    WHERE a.t <= p.t - 0.15 + 50 AND b.t <= p.t + 0.35 + 50""", "samples")
def _(spark, d):
    return studies.step_around(samples(spark, d), instants(spark, d), KEY, "ax", 0.15, 0.35, 50.0).filter("step is not null").withColumnRenamed("at", "at_t")


@query("m23_rest_momentum", "capture_id start_i stop_i", "dv", f"""
  WITH RECURSIVE {_PICK}, iv AS (SELECT capture_id, i AS start_i, lead(i) OVER (PARTITION BY capture_id ORDER BY i) AS stop_i FROM picked)
  SELECT capture_id, start_i, stop_i, (SELECT coalesce(sum((s.az + p.az)/2*(s.t - p.t)), 0) FROM samples s JOIN samples p ON p.capture_id = s.capture_id AND p.i = s.i - 1
    WHERE s.capture_id = iv.capture_id AND s.i > start_i AND s.i < stop_i) AS dv FROM iv WHERE stop_i IS NOT NULL""", "samples")
def _(spark, d):
    return studies.momentum_between(samples(spark, d), picked(spark, d), KEY, "az")


@query("m24_peaks_between", "capture_id gap_no", "peak peak_t", f"""
  WITH RECURSIVE {_PICK}, m AS (SELECT capture_id, i FROM picked UNION SELECT DISTINCT capture_id, 0 FROM samples UNION ALL SELECT DISTINCT capture_id, n FROM samples),
  g AS (SELECT capture_id, i AS a, lead(i) OVER w AS b, row_number() OVER w - 1 AS gap_no FROM m WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  SELECT g.capture_id, gap_no, max(value) AS peak, arg_min(t, struct_pack(v := -value, i := i)) AS peak_t FROM g JOIN samples s ON s.capture_id = g.capture_id AND s.i >= a AND s.i < b
  WHERE b IS NOT NULL GROUP BY 1, 2 HAVING max(value) > 20""", "samples")
def _(spark, d):
    return studies.peaks_between(samples(spark, d), picked(spark, d), KEY, "value", 20.0)


@query("m25_band_health", "clip_id", "good_low spread_high", """
  SELECT clip_id, avg(CASE WHEN height < lo + 0.1 THEN (score > 0.6)::INT END) AS good_low, max(CASE WHEN height > hi - 0.05 THEN x END) - min(CASE WHEN height > hi - 0.05 THEN x END) AS spread_high
  FROM (SELECT *, min(height) OVER w AS lo, max(height) OVER w AS hi FROM track WHERE height IS NOT NULL WINDOW w AS (PARTITION BY clip_id)) GROUP BY 1""", "track", places=5)
def _(spark, d):
    return studies.band_health(track(spark, d), CLIP)


@query("m26_attitude_drift", "capture_id", "drift_deg", """
  WITH spot AS (SELECT capture_id, arg_min(lo, struct_pack(s := round(s*s, 9) + 0.0, lo := lo)) AS lo FROM (
    SELECT a.capture_id, lo, stddev_pop(sqrt(gx*gx+gy*gy+gz*gz)) AS s FROM (SELECT capture_id, max(t) AS tend FROM samples GROUP BY 1) a,
      LATERAL (SELECT unnest(range(0, (2*greatest(tend - 8.0, 0.1))::BIGINT + 2)) * 0.5 AS lo) g JOIN samples b ON b.capture_id = a.capture_id AND b.t >= lo AND b.t < lo + 8.0
    WHERE lo < greatest(tend - 8.0, 0.1) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1),
  e AS (SELECT s.capture_id, arg_min(0.01*event_id, i) AS a, arg_max(0.01*event_id, i) AS b FROM samples s JOIN spot USING (capture_id) WHERE t >= lo AND t < lo + 8.0 GROUP BY 1)
  SELECT capture_id, degrees(2*acos(least(1, abs(cos(b - a))))) AS drift_deg FROM e""", "samples", places=2)   # the attitudes turn about one axis
def _(spark, d):
    return studies.attitude_drift(samples(spark, d), KEY, motion.magnitude(motion.GYRO))


@query("m17_curvature_correlation", "capture_id", "corr", """
  WITH s AS (SELECT capture_id, i, ax - 2*lag(ax) OVER w + lag(ax, 2) OVER w AS a, ay - 2*lag(ay) OVER w + lag(ay, 2) OVER w AS b,
    az - 2*lag(az) OVER w + lag(az, 2) OVER w AS z FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  d AS (SELECT capture_id, g, corr(a*cos(g*pi()/8) + b*sin(g*pi()/8), z) AS c FROM s, (SELECT unnest(range(0, 8)) AS g) GROUP BY 1, 2)
  SELECT capture_id, max(abs(c)) AS corr FROM d GROUP BY 1""", "samples")
def _(spark, d):
    from kinetrail.plans.blocks import windowed

    s = windowed(samples(spark, d), KEY, lambda w: {
        c: F.col(x) - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w) for c, x in (("a", "ax"), ("b", "ay"), ("z", "az"))}, before=2)
    import math

    turned = s.groupBy(*KEY).agg(*[
        F.corr(F.col("a") * math.cos(g * math.pi / 8) + F.col("b") * math.sin(g * math.pi / 8), "z").alias(f"c{g}") for g in range(8)])
    return turned.select(*KEY, F.greatest(*[F.abs(f"c{g}") for g in range(8)]).alias("corr"))


@query("t6_nearest_to_median", "capture_id rep", "rom median", f"""
  WITH {_DET}, r AS (SELECT capture_id, rep, max(z) - min(z) AS rom FROM det GROUP BY 1, 2), m AS (SELECT capture_id, median(rom) AS md FROM r GROUP BY 1)
  SELECT capture_id, arg_min(rep, struct_pack(d := abs(rom - md), r := rep)) AS rep, arg_min(rom, struct_pack(d := abs(rom - md), r := rep)) AS rom, max(md) AS median FROM r JOIN m USING (capture_id) GROUP BY 1""", "samples reps", places=3)
def _(spark, d):
    r = paths(spark, d).groupBy(*KEY, "rep").agg((F.max("z") - F.min("z")).alias("rom"))
    return studies.nearest_to_median(settle(r), KEY, "rom", "rep")


# ---------------------------------------------------------------- what-if ----


_PARTS = """masked AS (SELECT s.capture_id, b.bin, s.i, s.t, s.dt, CASE WHEN (s.value > 60) = (b.bin = 'hot') THEN s.ax ELSE 0 END AS a FROM samples s
    JOIN (SELECT DISTINCT capture_id, CASE WHEN value > 60 THEN 'hot' ELSE 'rest' END AS bin FROM samples) b USING (capture_id)),
  vel AS (SELECT *, sum(s) OVER w AS v FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (a + lag(a) OVER w)/2*dt END AS s FROM masked WINDOW w AS (PARTITION BY capture_id, bin ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id, bin ORDER BY i)),
  pos AS (SELECT *, sum(s2) OVER w AS p FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (v + lag(v) OVER w)/2*dt END AS s2 FROM vel WINDOW w AS (PARTITION BY capture_id, bin ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id, bin ORDER BY i)),
  ends_ AS (SELECT p.capture_id, p.bin, r.rep, p.i, p.t, p.p, first_value(p.t) OVER w AS ft, last_value(p.t) OVER w AS lt, first_value(p.p) OVER w AS fp, last_value(p.p) OVER w AS lp
    FROM pos p JOIN reps r ON r.capture_id = p.capture_id AND p.i >= r.start_i AND p.i < r.stop_i
    WINDOW w AS (PARTITION BY p.capture_id, p.bin, r.rep ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  part AS (SELECT capture_id, bin, rep, i, p - fp - (t - ft)/(lt - ft)*(lp - fp) AS px FROM ends_),
  exc AS (SELECT capture_id, bin, rep, max(px) - min(px) AS excursion FROM part GROUP BY 1, 2, 3)"""


def parted(spark, d):
    s = samples(spark, d)
    return s, settle(whatif.attribution(s, bounds(spark, d), KEY, F.when(F.col("value") > 60, "hot").otherwise("rest"), AXES))


@query("o6_attribution", "capture_id bin rep", "excursion", f"WITH {_PARTS} SELECT * FROM exc", "samples reps", places=3)
def _(spark, d):
    _, parts = parted(spark, d)
    return parts.groupBy(*KEY, "bin", "rep").agg((F.max("px") - F.min("px")).alias("excursion"))


@query("o7_attribution_error", "capture_id small", "", f"""
  WITH {_PARTS}, pv AS (SELECT *, sum(s) OVER w AS v FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (ax + lag(ax) OVER w)/2*dt END AS s FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  pp AS (SELECT *, sum(s2) OVER w AS p FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (v + lag(v) OVER w)/2*dt END AS s2 FROM pv WINDOW w AS (PARTITION BY capture_id ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  whole AS (SELECT p.capture_id, r.rep, p.i, p.p - first_value(p.p) OVER w - (p.t - first_value(p.t) OVER w)/(last_value(p.t) OVER w - first_value(p.t) OVER w)
      *(last_value(p.p) OVER w - first_value(p.p) OVER w) AS px FROM pp p JOIN reps r ON r.capture_id = p.capture_id AND p.i >= r.start_i AND p.i < r.stop_i
    WINDOW w AS (PARTITION BY p.capture_id, r.rep ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  sums AS (SELECT capture_id, rep, i, sum(px) AS px FROM part GROUP BY 1, 2, 3)
  SELECT capture_id, max(abs(sums.px - whole.px)) < 1e-6 AS small FROM sums JOIN whole USING (capture_id, rep, i) GROUP BY 1""", "samples reps")
def _(spark, d):
    s, parts = parted(spark, d)
    whole = correct.detrend(settle(motion.double_integral(s, KEY, AXES)), bounds(spark, d), KEY)
    return whatif.attribution_error(parts, whole, KEY).withColumn("small", F.col("worst") < 1e-6)


@query("m28_event_share", "capture_id", "share", f"""
  WITH {_PARTS} SELECT capture_id, median(hot/total) AS share FROM (
    SELECT capture_id, rep, coalesce(max(excursion) FILTER (WHERE bin = 'hot'), 0) AS hot, sum(excursion) AS total FROM exc GROUP BY 1, 2) GROUP BY 1""", "samples reps", places=3)
def _(spark, d):
    _, parts = parted(spark, d)
    per = parts.groupBy(*KEY, "rep", "bin").agg((F.max("px") - F.min("px")).alias("_e"))
    wide = per.groupBy(*KEY, "rep").agg(F.max(F.when(F.col("bin") == "hot", F.col("_e"))).alias("hot"), F.sum("_e").alias("all_"))
    return exact_medians(wide, KEY, {"share": F.coalesce("hot", F.lit(0.0)) / F.col("all_")})


@query("o1_rebuild_grid", "param_id capture_id", "h_rms", places=3)
def _(spark, d):
    own = whatif.grid_candidates({"bias_x": [-0.02, 0.0, 0.02], "lever_x": [0.0, 0.09]}, {"bias": ("bias_x", 0.0, 0.0), "lever": ("lever_x", 0.0, 0.0)})
    flat = [f"{p}_{k}" for k in range(len(own)) for p in ("px", "py")]
    x = whatif.rebuild_each(samples(spark, d), KEY, own)
    path = correct.detrend(x.select(*KEY, "i", "n", BLOCK, "t", *flat), bounds(spark, d), KEY, flat, axes=range(len(flat)))
    per = path.groupBy(*KEY, "rep").agg(*[
        (F.sqrt(F.avg(F.col(f"px_{k}") ** 2 + F.col(f"py_{k}") ** 2)) * 100).alias(f"v_{k}") for k in range(len(own))])
    long = per.select(*KEY, F.explode(F.array(*[
        F.struct(F.lit(k).alias("param_id"), F.col(f"v_{k}").alias("v")) for k in range(len(own))])).alias("_e")).select(*KEY, "_e.*")
    return exact_medians(long, [*KEY, "param_id"], {"h_rms": "v"})


@query("o8_lever_directions", "capture_id param_id", "sweep")
def _(spark, d):
    return whatif.lever_sweep(samples(spark, d), bounds(spark, d), KEY, whatif.fibonacci_directions(spark, 60))


@query("o5_rest_observables", "capture_id i rep", "overlap gain", f"""
  WITH RECURSIVE {_PICK}, w AS (SELECT p.capture_id, p.i, lead(p.i) OVER k AS ni, lead(s.ax) OVER k - s.ax AS gain FROM picked p JOIN samples s ON s.capture_id = p.capture_id AND s.i = p.i
    WINDOW k AS (PARTITION BY p.capture_id ORDER BY p.i)),
  o AS (SELECT w.*, -r.rep AS r, least(ni, r.stop_i - 1) - greatest(w.i, r.start_i) AS ov FROM w JOIN reps r ON r.capture_id = w.capture_id WHERE ni IS NOT NULL)
  SELECT capture_id, i, -arg_max(r, struct_pack(o := ov, r := r)) AS rep, max(ov)::DOUBLE AS overlap, max(gain) AS gain FROM o WHERE ov > 0 GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    from kinetrail.plans.blocks import neighbours

    p = picked(spark, d).select(*KEY, "i", BLOCK).join(samples(spark, d).select(*KEY, "i", "ax"), [*KEY, "i"])
    w = neighbours(p, KEY, {"ni": "i", "_n": "ax"}, step=1).filter("ni is not null").withColumn("gain", F.col("_n") - F.col("ax"))
    return whatif.best_overlap(w.select(*KEY, "i", "ni", "gain"), bounds(spark, d), KEY, ("i", "ni"))


# ----------------------------------------------------------------- reports ---


@query("q1_capture_rollup", "lift session captures", "mid_rom", f"""
  WITH {_DET}, r AS (SELECT capture_id, max(z) - min(z) AS rom FROM det GROUP BY 1)
  SELECT (['bench','squat','deadlift','row'])[capture_id % 4 + 1] AS lift, capture_id % 3 AS session, count(*) AS captures, avg(rom) AS mid_rom FROM r GROUP BY ROLLUP (1, 2)""", "samples reps")
def _(spark, d):
    r = lifted(paths(spark, d).groupBy(*KEY).agg((F.max("z") - F.min("z")).alias("rom")))
    return r.withColumn("session", F.col("capture_id") % 3).rollup("lift", "session").agg(
        F.count(F.lit(1)).alias("captures"), F.avg("rom").alias("mid_rom"))


_PER_CAPTURE = f"""{_M5}, pc AS (SELECT n.capture_id, median(pipeline_h_rms) AS h, median(null_h_rms)/median(pipeline_h_rms) AS b
    FROM (SELECT DISTINCT capture_id FROM cov) n LEFT JOIN pr USING (capture_id) GROUP BY 1)"""


@query("q3_scorecard", "lift captures", "h_rms beats_null", f"""
  WITH {_PER_CAPTURE} SELECT (['bench','squat','deadlift','row'])[capture_id % 4 + 1] AS lift, count(*) AS captures, median(h) AS h_rms, median(b) AS beats_null
  FROM pc GROUP BY 1""", "samples reps track", places=2)
def _(spark, d):
    c = lifted(scored(spark, d)[1])
    n = c.groupBy("lift").agg(F.count(F.lit(1)).alias("captures"))
    return n.join(exact_medians(c, ["lift"], {"h_rms": "pipeline_h_rms", "beats_null": "beats_null"}), "lift", "left")


@query("q2_range_table", "capture_id reps_", "log_rom track_rom", f"""
  WITH {_M5}, r AS (SELECT capture_id, rep, max(z) - min(z) AS rom FROM det GROUP BY 1, 2), v AS (SELECT capture_id, median(video_rom_cm) AS track_rom FROM pr GROUP BY 1)
  SELECT r.capture_id, count(*) AS reps_, median(rom) AS log_rom, max(track_rom) AS track_rom FROM r LEFT JOIN v ON v.capture_id = r.capture_id GROUP BY 1""", "samples reps track", places=3)
def _(spark, d):
    p = paths(spark, d).groupBy(*KEY, "rep").agg((F.max("z") - F.min("z")).alias("rom"))
    mine = exact_medians(p, KEY, {"log_rom": "rom"}).join(p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("reps_")), KEY)
    ref = exact_medians(scored(spark, d)[0], KEY, {"track_rom": "video_rom_cm"})
    return mine.join(ref, KEY, "left")


@query("q11_arm_comparison", "capture_id", "off on_ change", """
  SELECT capture_id, stddev_pop(ax) AS off, stddev_pop(ax + 0.1*ay) AS on_, stddev_pop(ax + 0.1*ay) - stddev_pop(ax) AS change FROM samples GROUP BY 1""", "samples")
def _(spark, d):
    arms = samples(spark, d).withColumn("arm", F.explode(F.array(F.lit("off"), F.lit("on_")))).withColumn(
        "v", F.when(F.col("arm") == "on_", F.col("ax") + 0.1 * F.col("ay")).otherwise(F.col("ax")))
    got = arms.groupBy(*KEY).pivot("arm", ["off", "on_"]).agg(F.stddev_pop("v"))
    return got.withColumn("change", F.col("on_") - F.col("off"))


@query("q13_parabola_growth", "capture_id points", "spearman", f"""
  WITH {_DET}, c AS (SELECT capture_id, rep, abs(sum(tau*(tau - dur)/2*x)/sum(pow(tau*(tau - dur)/2, 2))) AS c FROM det GROUP BY 1, 2),
  r AS (SELECT capture_id, rank() OVER (PARTITION BY capture_id ORDER BY rep) AS ra, rank() OVER (PARTITION BY capture_id ORDER BY c) AS rb FROM c)
  SELECT capture_id, count(*) AS points, corr(ra, rb) AS spearman FROM r GROUP BY 1""", "samples reps")
def _(spark, d):
    fit = correct.parabola_coefficients(paths(spark, d), [*KEY, "rep"], ["x"], F.col("tau"), F.col("duration"))
    return score.spearman(settle(fit.withColumn("c", F.abs("c_x")).select(*KEY, "rep", "c")), KEY, "rep", "c")


@query("q12_phase_profile", "capture_id bin", "mid", places=3)
def _(spark, d):
    from kinetrail.operators.calibrate import fusion_split

    x = fusion_split(samples(spark, d), KEY)
    rows = correct.cut(x, bounds(spark, d), KEY)
    size = F.col("stop_i") - F.col("start_i")
    rows = rows.withColumn("bin", F.floor(F.col("j") * 20 / size).cast("long"))
    return exact_medians(rows, [*KEY, "bin"], {"mid": "tilt_rate"})
