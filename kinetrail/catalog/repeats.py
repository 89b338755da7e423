"""Calibration, per-repetition correction and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, query, reps, samples, table, track
from kinetrail.catalog.events import _PICK, _REST, _ROLL, clock, picked, rests
from kinetrail.catalog.signals import _HOLDS, _INV, _RANKED, _STILL, _sql_rotate
from kinetrail.functions import rules
from kinetrail.operators import calibrate, correct, motion, quality, score, windows
from kinetrail.plans.blocks import BLOCK, lookup, per_key, settle
from kinetrail.plans.joins import interval_join
from kinetrail.plans.quantiles import exact_medians

AXES = ("ax", "ay", "az")
STILL: dict = {}


def bounds(spark, d):
    return reps(spark, d).drop("n", BLOCK)


# ------------------------------------------------------------ B: calibrate ---


@query("b1_gyro_bias", "capture_id confident start_i stop_i", "raw_gx raw_gy raw_gz residual", f"""
  WITH {_STILL}, raw AS (SELECT capture_id, start_i, stop_i, avg(gx) AS raw_gx, avg(gy) AS raw_gy, avg(gz) AS raw_gz FROM samples
    JOIN still USING (capture_id) WHERE i >= start_i AND i < stop_i GROUP BY ALL)
  SELECT raw.*, avg(sqrt(pow(gx-raw_gx,2)+pow(gy-raw_gy,2)+pow(gz-raw_gz,2))) AS residual,
    avg(sqrt(pow(gx-raw_gx,2)+pow(gy-raw_gy,2)+pow(gz-raw_gz,2))) < 0.09 AS confident
  FROM samples JOIN raw USING (capture_id) WHERE i >= start_i AND i < stop_i GROUP BY ALL""", "rated", places=7)
def _(spark, d):
    return calibrate.gyro_bias(samples(spark, d), KEY, max_rate=0.09, **STILL)


@query("b1_gyro_bias_fallback", "capture_id used_fallback", "bias_gx sem_gx snr_gx")
def _(spark, d):
    got = calibrate.gyro_bias(samples(spark, d), KEY, apply=True, fallback=(0.01, 0.0, 0.0), max_rate=0.09, **STILL)
    return got


@query("b2_initial_tilt", "capture_id", "tilt_ax tilt_ay tilt_az", f"""
  WITH {_STILL} SELECT capture_id, avg(ax) AS tilt_ax, avg(ay) AS tilt_ay, avg(az) AS tilt_az FROM samples
  JOIN still USING (capture_id) WHERE i >= start_i AND i < stop_i GROUP BY 1""", "rated", places=7)
def _(spark, d):
    return calibrate.initial_tilt(samples(spark, d), KEY, **STILL)


@query("b3_remove_accel_bias", "capture_id i", "ax ay az", f"""
  WITH {_STILL}, b AS (SELECT capture_id, avg(ax) AS bx, avg(ay) AS b2, avg(az) AS bz FROM samples
    JOIN still USING (capture_id) WHERE i >= start_i AND i < stop_i GROUP BY 1)
  SELECT capture_id, i, ax - bx AS ax, ay - b2 AS ay, az - bz AS az FROM samples JOIN b USING (capture_id)""", "rated", places=7)
def _(spark, d):
    return calibrate.remove_accel_bias(samples(spark, d), KEY, AXES, **STILL)


@query("b4_hold_tilt", "capture_id open_i close_i", "open_deg close_deg change_deg span_s", f"""
  WITH {_RANKED}, {_HOLDS}, per AS (SELECT capture_id, hold, degrees(asin(least(sqrt(avg(ax)*avg(ax)+avg(ay)*avg(ay))/9.80665, 1))) AS deg,
    max(CASE WHEN k - start_k = len // 2 THEN i END) AS mi, max(CASE WHEN k - start_k = len // 2 THEN t END) AS mt FROM held GROUP BY 1, 2)
  SELECT o.capture_id, o.mi AS open_i, c.mi AS close_i, o.deg AS open_deg, c.deg AS close_deg, c.deg - o.deg AS change_deg, c.mt - o.mt AS span_s
  FROM per o JOIN per c ON o.capture_id = c.capture_id AND o.hold = 'open' AND c.hold = 'close'""", "rated")
def _(spark, d):
    return calibrate.hold_tilt(samples(spark, d), KEY, AXES)


@query("b4_gyro_only_drift", "capture_id", "gyro_only_deg")
def _(spark, d):
    s = samples(spark, d)
    return calibrate.gyro_only_drift(s, settle(calibrate.hold_tilt(s, KEY, AXES)), KEY)


_BODY = _sql_rotate(_INV, ("ax", "ay", "az"))


@query("b5_body_frame_bias", "capture_id", "body_x body_y body_z", f"""
  WITH {_STILL} SELECT capture_id, avg({_BODY[0]}) AS body_x, avg({_BODY[1]}) AS body_y, avg({_BODY[2]}) AS body_z FROM samples
  JOIN still USING (capture_id) WHERE i >= start_i AND i < stop_i GROUP BY 1""", "rated")
def _(spark, d):
    return calibrate.body_frame_bias(samples(spark, d), KEY, world=AXES, **STILL)


@query("b6_split_bias", "capture_id rank", "body_x body_y body_z tilt_x tilt_y tilt_z", places=3)
def _(spark, d):
    return calibrate.split_bias(settle(samples(spark, d)), KEY, world=AXES)


@query("b7_fusion_split", "capture_id moving", "tilt yaw", places=3)
def _(spark, d):
    x = calibrate.fusion_split(samples(spark, d), KEY).withColumn("moving", motion.magnitude(motion.GYRO) > 0.08)
    return exact_medians(x, [*KEY, "moving"], {"tilt": "tilt_rate", "yaw": "yaw_rate"})


@query("b8_rep_residual", "capture_id rep", "residual", """
  SELECT capture_id, rep, sqrt(avg(ax)*avg(ax) + avg(ay)*avg(ay))/9.80665 AS residual FROM reps r JOIN samples s USING (capture_id)
  WHERE s.i >= start_i AND s.i < stop_i GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    from kinetrail.operators.studies import rep_residual

    return rep_residual(samples(spark, d), bounds(spark, d), KEY, AXES)


@query("b8_impact_exclusion", "capture_id pad", "residual", f"""
  WITH RECURSIVE {_PICK}, per AS (SELECT r.capture_id, g.pad, r.rep, sqrt(avg(ax)*avg(ax) + avg(ay)*avg(ay)) AS v FROM reps r
    JOIN samples s ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i, (SELECT unnest([0, 1, 2]) AS pad) g
    WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.capture_id = s.capture_id AND s.i BETWEEN p.i - g.pad AND p.i + g.pad)
    GROUP BY 1, 2, 3 HAVING count(*) > 2)
  SELECT capture_id, pad, median(v)/9.80665 AS residual FROM per GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    from kinetrail.operators.studies import exclusion_sweep

    return exclusion_sweep(samples(spark, d), bounds(spark, d), picked(spark, d), KEY, [0, 1, 2], AXES, least=2)


# -------------------------------------------------------------- C: correct ---

_REPROWS = """rows_ AS (SELECT s.*, r.rep, r.start_i, r.stop_i, s.i - r.start_i AS j, s.t - first_value(s.t) OVER w AS tau,
    last_value(s.t) OVER w - first_value(s.t) OVER w AS dur,
    first_value(ax) OVER w AS fax, last_value(ax) OVER w AS lax, first_value(ay) OVER w AS fay, last_value(ay) OVER w AS lay,
    first_value(az) OVER w AS faz, last_value(az) OVER w AS laz, first_value(gx) OVER w AS fgx, last_value(gx) OVER w AS lgx
  FROM samples s JOIN reps r ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i
  WINDOW w AS (PARTITION BY s.capture_id, r.rep ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("c1_line_detrend", "capture_id rep i", "ax ay az", f"""
  WITH {_REPROWS} SELECT capture_id, rep, i, ax - tau/dur*(lax-fax) AS ax, ay - tau/dur*(lay-fay) AS ay, az FROM rows_""", "samples reps")
def _(spark, d):
    return correct.detrend(samples(spark, d), bounds(spark, d), KEY, AXES, axes=(0, 1), from_origin=False)


@query("c1_edge_median_detrend", "capture_id rep i", "ax", """
  WITH r3 AS (SELECT s.capture_id, r.rep, s.i, s.t, s.ax, s.t - min(s.t) OVER w AS tau,
      median(s.ax) FILTER (WHERE s.i >= r.stop_i - 3) OVER w - median(s.ax) FILTER (WHERE s.i < r.start_i + 3) OVER w AS d,
      avg(s.t) FILTER (WHERE s.i >= r.stop_i - 3) OVER w - avg(s.t) FILTER (WHERE s.i < r.start_i + 3) OVER w AS span
    FROM samples s JOIN reps r ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i WINDOW w AS (PARTITION BY s.capture_id, r.rep))
  SELECT capture_id, rep, i, ax - tau/span*d AS ax FROM r3""", "samples reps")
def _(spark, d):
    return correct.detrend(samples(spark, d), bounds(spark, d), KEY, ("ax",), axes=(0,), edge=3, from_origin=False)


@query("c2_velocity_closure_detrend", "capture_id rep i", "ax", f"""
  WITH {_REPROWS} SELECT capture_id, rep, i, ax - ((lgx-fgx)/(2*dur)*tau*tau + ((lax-fax)/dur - (lgx-fgx)/2)*tau) AS ax FROM rows_""", "samples reps")
def _(spark, d):
    return correct.detrend(samples(spark, d), bounds(spark, d), KEY, ("ax",), axes=(0,), order=2, velocity=("gx",), from_origin=False)


_DET = f"{_REPROWS}, det AS (SELECT capture_id, rep, i, j, n, t, tau, dur, start_i, stop_i, ax - tau/dur*(lax-fax) - fax AS x, ay - tau/dur*(lay-fay) - fay AS y, az - tau/dur*(laz-faz) - faz AS z FROM rows_)"


def paths(spark, d):
    """Detrended reps, starting at the origin, as x y z."""
    return correct.detrend(samples(spark, d), bounds(spark, d), KEY, AXES).withColumnsRenamed(
        {"ax": "x", "ay": "y", "az": "z"})


XYZ = ("x", "y", "z")


@query("c3_detrend_set", "capture_id rep i", "x y z", f"WITH {_DET} SELECT capture_id, rep, i, x, y, z FROM det", "samples reps")
def _(spark, d):
    return paths(spark, d)


_KNOTS = """knots AS (SELECT capture_id, i, t, ax FROM samples WHERE event_id % 7 = 0),
  kn AS (SELECT *, lead(t) OVER w AS t2, lead(ax) OVER w AS ax2, count(*) OVER (PARTITION BY capture_id) AS c, first_value(ax) OVER w AS ref
    FROM knots WINDOW w AS (PARTITION BY capture_id ORDER BY i))"""


@query("c4_knot_detrend", "capture_id i", "ax", f"""
  WITH {_KNOTS} SELECT s.capture_id, s.i, CASE WHEN coalesce(k.c, f.c, 0) < 2 THEN s.ax
      WHEN k.i IS NULL THEN s.ax WHEN k.t2 IS NULL THEN s.ax - (k.ax - k.ref)
      ELSE s.ax - (k.ax + (k.ax2 - k.ax) * (s.t - k.t) / (k.t2 - k.t) - k.ref) END AS ax
  FROM samples s ASOF LEFT JOIN kn k ON k.capture_id = s.capture_id AND s.i >= k.i
  LEFT JOIN (SELECT capture_id, max(c) AS c FROM kn GROUP BY 1) f ON f.capture_id = s.capture_id""", "samples")
def _(spark, d):
    s = samples(spark, d)
    return correct.detrend_knots(s, s.filter("event_id % 7 = 0"), KEY, ("ax",))


@query("c5_rest_windows", "capture_id rep start_i stop_i", "", f"""
  WITH RECURSIVE {_PICK} SELECT * FROM (SELECT capture_id, row_number() OVER w - 1 AS rep, i AS start_i, lead(i) OVER w + 1 AS stop_i FROM picked
  WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WHERE stop_i IS NOT NULL""", "samples")
def _(spark, d):
    return correct.rest_windows(picked(spark, d), KEY)


_PARA = """fit AS (SELECT capture_id, rep, sum(b*x)/sum(b*b) AS c, sum(x*x) AS yy, max(x)-min(x) AS excursion,
    sum(pow(x - (SELECT 0), 2)) AS s2 FROM pb GROUP BY 1, 2)"""


@query("a6_parabola_fit", "capture_id rep", "c_x r2_x tilt_deg_x excursion_x", f"""
  WITH {_DET}, pb AS (SELECT *, (j*dur/9.0)*((j*dur/9.0) - dur)/2 AS b FROM det), fit AS (SELECT capture_id, rep, sum(b*x)/sum(b*b) AS c FROM pb GROUP BY 1, 2)
  SELECT capture_id, rep, max(c) AS c_x, 1 - sum(pow(x - c*b, 2))/sum(x*x) AS r2_x, degrees(asin(least(1, abs(max(c))/9.80665))) AS tilt_deg_x,
    max(x) - min(x) AS excursion_x FROM pb JOIN fit USING (capture_id, rep) GROUP BY 1, 2""", "samples reps", places=3)
def _(spark, d):
    size = F.col("stop_i") - F.col("start_i") - 1
    return correct.parabola_coefficients(
        paths(spark, d), [*KEY, "rep"], ["x"], F.col("j") * F.col("duration") / size, F.col("duration"))


@query("p10_parabola_basis", "capture_id rep i", "basis", f"""
  WITH {_DET} SELECT capture_id, rep, i, tau*(tau-dur)/2 AS basis FROM det""", "samples reps")
def _(spark, d):
    return paths(spark, d).withColumn("basis", rules.parabola(F.col("tau"), F.col("duration")))


@query("c6_remove_parabola", "capture_id rep i", "x y", f"""
  WITH {_DET}, pb AS (SELECT *, tau*(tau-dur)/2 AS b FROM det), fit AS (SELECT capture_id, rep, sum(b*x)/sum(b*b) AS cx, sum(b*y)/sum(b*b) AS cy FROM pb GROUP BY 1, 2)
  SELECT capture_id, rep, i, x - cx*b AS x, y - cy*b AS y FROM pb JOIN fit USING (capture_id, rep)""", "samples reps")
def _(spark, d):
    return correct.remove_parabola(paths(spark, d), KEY, ["x", "y"])


# C7-C10 work on integrated series; a small SQL of the same steps is the oracle
_INT = """it AS (SELECT *, sum(ga) OVER w AS vx FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (ax + lag(ax) OVER w)/2*dt END AS ga FROM samples
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  pr AS (SELECT capture_id, i AS i0, t AS t0, lead(i) OVER w AS i1, lead(t) OVER w AS t1 FROM picked WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  jump AS (SELECT p.capture_id, a, b, (v1.vx - v0.vx)/(tb.t - ta.t) AS c FROM {span} p
    JOIN it v0 ON v0.capture_id = p.capture_id AND v0.i = p.i0 JOIN it v1 ON v1.capture_id = p.capture_id AND v1.i = p.i1
    JOIN it ta ON ta.capture_id = p.capture_id AND ta.i = a JOIN it tb ON tb.capture_id = p.capture_id AND tb.i = b WHERE tb.t > ta.t),
  fx AS (SELECT it.capture_id, it.i, it.dt, it.ax - coalesce((SELECT sum(c) FROM jump j WHERE j.capture_id = it.capture_id AND it.i BETWEEN j.a AND j.b), 0) AS ax FROM it),
  v AS (SELECT *, sum(g) OVER w AS vx FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (ax + lag(ax) OVER w)/2*dt END AS g FROM fx
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  out AS (SELECT capture_id, i, vx, sum(h) OVER w AS px FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (vx + lag(vx) OVER w)/2*dt END AS h FROM v
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WINDOW w AS (PARTITION BY capture_id ORDER BY i))"""
_V3, _P3 = ("vx",), ("px",)


def integrated(spark, d):
    s = samples(spark, d)
    med = per_key(s, KEY).join(exact_medians(s, KEY, {"dt_median": "dt"}), KEY)
    return settle(lookup(motion.double_integral(s, KEY, ("ax",), _V3, _P3), KEY, med))


def marks(spark, d):
    """Impacts for the rest marks: hot samples off the rests."""
    s = samples(spark, d)
    return s.filter("value > 45 and value <= 60")


_IMP = "imp AS (SELECT capture_id, i FROM samples WHERE value > 45 AND value <= 60)"


@query("c7_interval_correction", "capture_id i", "vx px",
       f"WITH RECURSIVE {_PICK}, {_INT.format(span='(SELECT *, i0 AS a, i1 AS b FROM pr WHERE i1 IS NOT NULL)')} SELECT * FROM out", "samples", places=3)
def _(spark, d):
    x = integrated(spark, d)
    win = correct.jump_windows(picked(spark, d), marks(spark, d), x, KEY, None)
    return correct.spread_jumps(x, win, KEY, axes=(0,), world=("ax",), velocity=_V3, position=_P3)


_WIDE = """(SELECT q.capture_id, q.i0, q.i1, q.a, least(q.i1, q.a + greatest(1, round_even(0.4/m.md, 0)::BIGINT)) AS b FROM (
    SELECT pr.*, (SELECT max(i) FROM imp WHERE imp.capture_id = pr.capture_id AND imp.i > pr.i0 AND imp.i <= pr.i1) AS a FROM pr WHERE i1 IS NOT NULL) q
    JOIN (SELECT capture_id, median(dt) AS md FROM samples GROUP BY 1) m ON m.capture_id = q.capture_id WHERE a IS NOT NULL)"""


@query("c8_jump_correction", "capture_id i", "vx px",
       f"WITH RECURSIVE {_PICK}, {_IMP}, {_INT.format(span=_WIDE)} SELECT * FROM out", "samples", places=3)
def _(spark, d):
    x = integrated(spark, d)
    win = correct.jump_windows(picked(spark, d), marks(spark, d), x, KEY, 0.4)
    return correct.spread_jumps(x, win, KEY, axes=(0,), world=("ax",), velocity=_V3, position=_P3)


@query("c9_jump_then_knots", "capture_id i", "px", places=3)
def _(spark, d):
    x = integrated(spark, d)
    p = picked(spark, d)
    moved = correct.spread_jumps(x, correct.jump_windows(p, marks(spark, d), x, KEY, 0.0), KEY, axes=(0,), world=("ax",), velocity=_V3, position=_P3)
    holds = windows.hold_windows(samples(spark, d), KEY).groupBy(*KEY, "hold").agg(
        F.floor(F.avg("i")).cast("long").alias("mid_i"))
    return correct.detrend_knots(settle(moved), correct.rest_knots(x, p, holds, KEY), KEY, _P3)


@query("u4_rest_knots", "capture_id i", "", f"""
  WITH RECURSIVE {_PICK}, {_RANKED}, {_HOLDS}, mids AS (SELECT capture_id, hold, floor(avg(i))::BIGINT AS m FROM held GROUP BY 1, 2)
  SELECT DISTINCT capture_id, i FROM (SELECT capture_id, i FROM picked
    UNION ALL SELECT k.capture_id, coalesce(m, 0) FROM (SELECT DISTINCT capture_id FROM samples) k LEFT JOIN mids ON mids.capture_id = k.capture_id AND hold = 'open'
    UNION ALL SELECT k.capture_id, coalesce(m, k.n - 1) FROM (SELECT DISTINCT capture_id, n FROM samples) k LEFT JOIN mids ON mids.capture_id = k.capture_id AND hold = 'close')""", "rated")
def _(spark, d):
    holds = windows.hold_windows(samples(spark, d), KEY).groupBy(*KEY, "hold").agg(
        F.floor(F.avg("i")).cast("long").alias("mid_i"))
    return correct.rest_knots(samples(spark, d), picked(spark, d), holds, KEY)


@query("c9_jump_rest_windows", "capture_id rep i", "px", places=3)
def _(spark, d):
    x, p = integrated(spark, d), settle(picked(spark, d))
    moved = correct.spread_jumps(x, correct.jump_windows(p, marks(spark, d), x, KEY, 0.4), KEY, axes=(0,), world=("ax",), velocity=_V3, position=_P3)
    return correct.detrend(settle(moved), correct.rest_windows(p, KEY), KEY, _P3, axes=(0,))


@query("c10_velocity_splice", "capture_id i", "vx", f"""
  WITH RECURSIVE {_PICK}, {_IMP}, it AS (SELECT *, sum(ga) OVER w AS vx FROM (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (ax + lag(ax) OVER w)/2*dt END AS ga FROM samples
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  own AS (SELECT p.capture_id, p.i AS r, (SELECT max(i) FROM imp WHERE imp.capture_id = p.capture_id AND imp.i < p.i) AS k FROM picked p),
  st AS (SELECT o.capture_id, o.r, o.k, ik.t AS tk, ir.t AS tr, ir.vx - coalesce(lag(ir.vx) OVER (PARTITION BY o.capture_id ORDER BY o.r), 0) AS e
    FROM own o JOIN it ir ON ir.capture_id = o.capture_id AND ir.i = o.r JOIN it ik ON ik.capture_id = o.capture_id AND ik.i = o.k WHERE o.k IS NOT NULL)
  SELECT it.capture_id, it.i, it.vx - coalesce((SELECT sum(CASE WHEN it.i > st.r THEN e ELSE e*(it.t - tk)/(tr - tk) END) FROM st
    WHERE st.capture_id = it.capture_id AND st.k <= it.i), 0) AS vx FROM it""", "samples")
def _(spark, d):
    return correct.splice_velocity(integrated(spark, d), picked(spark, d), marks(spark, d), KEY, _V3, axes=(0,))


@query("c11_zero_mean_per_rep", "capture_id rep i", "ax", """
  SELECT s.capture_id, r.rep, s.i, ax - avg(ax) OVER (PARTITION BY s.capture_id, r.rep) AS ax FROM samples s JOIN reps r
  ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i""", "samples reps")
def _(spark, d):
    from kinetrail.operators.studies import zero_mean_reps

    return zero_mean_reps(samples(spark, d), bounds(spark, d), KEY, ("ax",))


# ---------------------------------------------------------------- M: score ---

_GRID = f"""{_DET}, grid AS (SELECT a.capture_id, a.rep, g.g, a.x + (coalesce(b.x, a.x) - a.x)*fr AS x, a.y + (coalesce(b.y, a.y) - a.y)*fr AS y, a.z + (coalesce(b.z, a.z) - a.z)*fr AS z
  FROM (SELECT g, (g*9)//99 AS lo, ((g*9)%99)/99.0 AS fr FROM (SELECT unnest(range(0, 100)) AS g)) g
  JOIN det a ON a.j = g.lo LEFT JOIN det b ON b.capture_id = a.capture_id AND b.rep = a.rep AND b.j = a.j + 1)"""


def grid_rows(spark, d):
    return score.resample_reps(paths(spark, d), KEY, XYZ)


@query("m1_resample_reps", "capture_id rep g", "x y z", f"WITH {_GRID} SELECT * FROM grid", "samples reps")
def _(spark, d):
    return grid_rows(spark, d)


@query("m2_dispersion", "capture_id n_reps worst_rep", "horizontal_rms horizontal_p95 vertical_rms rms_x tempo_corr", f"""
  WITH {_GRID}, dv AS (SELECT *, sqrt(dx*dx+d2*d2) AS h, abs(dz) AS v FROM (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS d2, z - avg(z) OVER w AS dz
    FROM grid WINDOW w AS (PARTITION BY capture_id, g))),
  sp AS (SELECT capture_id, rep, avg(h) AS spread FROM dv GROUP BY 1, 2),
  du AS (SELECT capture_id, rep, dur, abs(dur - median(dur) OVER (PARTITION BY capture_id)) AS off FROM (SELECT DISTINCT capture_id, rep, dur FROM det)),
  tc AS (SELECT capture_id, CASE WHEN count(*) >= 5 AND stddev_pop(off) > 1e-9 AND stddev_pop(spread) > 1e-9 THEN corr(off, spread) END AS tempo_corr
    FROM sp JOIN du USING (capture_id, rep) GROUP BY 1)
  SELECT dv.capture_id, count(DISTINCT rep) AS n_reps, (SELECT arg_max(rep, spread) FROM sp WHERE sp.capture_id = dv.capture_id) AS worst_rep,
    sqrt(avg(h*h))*100 AS horizontal_rms, quantile_cont(h, 0.95)*100 AS horizontal_p95, sqrt(avg(v*v))*100 AS vertical_rms, sqrt(avg(dx*dx))*100 AS rms_x,
    max(tempo_corr) AS tempo_corr FROM dv LEFT JOIN tc USING (capture_id) GROUP BY dv.capture_id HAVING count(DISTINCT rep) >= 2""", "samples reps", places=3)
def _(spark, d):
    p = settle(paths(spark, d))
    lengths = p.filter("j = 0").select(*KEY, "rep", "duration")
    return score.dispersion(score.resample_reps(p, KEY, XYZ, once=True), lengths, KEY, XYZ)


@query("t4_worst_rep", "capture_id rep", "spread", f"""
  WITH {_GRID}, dv AS (SELECT *, sqrt(dx*dx+d2*d2) AS h FROM (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS d2 FROM grid WINDOW w AS (PARTITION BY capture_id, g)))
  SELECT capture_id, arg_max(rep, s) AS rep, max(s) AS spread FROM (SELECT capture_id, rep, avg(h) AS s FROM dv GROUP BY 1, 2) GROUP BY 1""", "samples reps")
def _(spark, d):
    per = score.deviations(settle(grid_rows(spark, d)), KEY, XYZ).groupBy(*KEY, "rep").agg(F.avg("horizontal").alias("spread"))
    return per.groupBy(*KEY).agg(F.max_by("rep", "spread").alias("rep"), F.max("spread").alias("spread"))


_M5 = f"""{_DET}, trk AS (SELECT clip_id AS capture_id, t, x AS tx, height AS th FROM track WHERE x IS NOT NULL),
  ax2 AS (SELECT capture_id, cos(0.5*atan2(2*b, a-c)) AS ux, sin(0.5*atan2(2*b, a-c)) AS uy FROM (
    SELECT capture_id, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM det GROUP BY 1)),
  cov AS (SELECT d.capture_id, d.rep, coalesce(min(d.t) >= max(lo) AND max(d.t) <= max(hi), false) AS covered FROM det d LEFT JOIN (
    SELECT capture_id, min(t) AS lo, max(t) AS hi FROM trk GROUP BY 1) k ON k.capture_id = d.capture_id GROUP BY 1, 2),
  ip AS (SELECT d.*, s.ax AS bx, s.ay AS b2, s.az AS bz, CASE WHEN p.t = q.t THEN p.tx ELSE p.tx + (q.tx-p.tx)*(d.t-p.t)/(q.t-p.t) END AS rx,
      CASE WHEN p.t = q.t THEN p.th ELSE p.th + (q.th-p.th)*(d.t-p.t)/(q.t-p.t) END AS rh
    FROM det d JOIN samples s ON s.capture_id = d.capture_id AND s.i = d.i JOIN cov ON cov.capture_id = d.capture_id AND cov.rep = d.rep AND covered
    ASOF LEFT JOIN trk p ON p.capture_id = d.capture_id AND d.t >= p.t ASOF LEFT JOIN trk q ON q.capture_id = d.capture_id AND d.t <= q.t),
  cu AS (SELECT ip.capture_id, ip.rep, i, j, rx - first_value(rx) OVER w AS ru, rh - first_value(rh) OVER w AS rhh,
      rx - first_value(rx) OVER w - tau/dur*(last_value(rx) OVER w - first_value(rx) OVER w) AS cu, x*ux + y*uy AS pu0, z AS ph,
      (bx - first_value(bx) OVER w)*ux + (b2 - first_value(b2) OVER w)*uy AS wu0, bz - first_value(bz) OVER w AS wh
    FROM ip JOIN ax2 ON ax2.capture_id = ip.capture_id WINDOW w AS (PARTITION BY ip.capture_id, ip.rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  ag AS (SELECT capture_id, rep, covar_pop(pu0, ru)*count(*) AS agree FROM cu GROUP BY 1, 2),
  sg AS (SELECT capture_id, sum(agree) < 0 AS flipped, CASE WHEN sum(agree) < 0 THEN count(*) FILTER (WHERE agree >= 0) ELSE count(*) FILTER (WHERE agree < 0) END AS disagreeing FROM ag GROUP BY 1),
  cs AS (SELECT cu.*, CASE WHEN flipped THEN -pu0 ELSE pu0 END AS pu, CASE WHEN flipped THEN -wu0 ELSE wu0 END AS wu FROM cu JOIN sg USING (capture_id)),
  pr AS (SELECT capture_id, rep, sqrt(avg(pow(wu-ru,2)))*100 AS raw_h_rms, sqrt(avg(pow(pu-ru,2)))*100 AS pipeline_h_rms, max(abs(pu-ru))*100 AS pipeline_h_max,
    sqrt(avg(pow(ph-rhh,2)))*100 AS pipeline_v_rms, sqrt(avg(pow(pu-cu,2)))*100 AS closed_h_rms, (max(rhh)-min(rhh))*100 AS video_rom_cm,
    sqrt(avg(ru*ru))*100 AS null_h_rms FROM cs GROUP BY 1, 2)"""


def scored(spark, d, lifts=None):
    trk = settle(track(spark, d).filter("x is not null").select(F.col("clip_id").alias("capture_id"), "t", "x", "height"))
    s = samples(spark, d).withColumns({"bx": F.col("ax"), "by": F.col("ay"), "bz": F.col("az")})
    p = correct.detrend(s, bounds(spark, d), KEY, AXES).withColumnsRenamed({"ax": "px", "ay": "py", "az": "pz"})
    return score.against_track(settle(p), trk, KEY, lifts)


@query("m5_score_per_rep", "capture_id rep covered", "raw_h_rms pipeline_h_rms pipeline_h_max pipeline_v_rms closed_h_rms video_rom_cm null_h_rms", f"""
  WITH {_M5} SELECT cov.capture_id, cov.rep, covered, pr.* EXCLUDE (capture_id, rep) FROM cov LEFT JOIN pr ON pr.capture_id = cov.capture_id AND pr.rep = cov.rep""",
       "samples reps track", places=2)
def _(spark, d):
    return scored(spark, d)[0]


@query("m5_score_per_capture", "capture_id n_reps n_compared flipped disagreeing", "pipeline_h_rms null_h_rms beats_null", f"""
  WITH {_M5}, n AS (SELECT capture_id, count(*) AS n_reps, count(*) FILTER (WHERE covered) AS n_compared FROM cov GROUP BY 1)
  SELECT n.capture_id, n_reps, n_compared, max(flipped) AS flipped, max(disagreeing) AS disagreeing, median(pipeline_h_rms) AS pipeline_h_rms,
    median(null_h_rms) AS null_h_rms, median(null_h_rms)/median(pipeline_h_rms) AS beats_null
  FROM n LEFT JOIN pr ON pr.capture_id = n.capture_id LEFT JOIN sg ON sg.capture_id = n.capture_id GROUP BY n.capture_id, n_reps, n_compared""",
       "samples reps track", places=2)
def _(spark, d):
    return scored(spark, d)[1]


@query("m5_refused_lifts", "capture_id n_reps refusal", "pipeline_h_rms", f"""
  WITH {_M5}, n AS (SELECT capture_id, count(*) AS n_reps FROM cov GROUP BY 1)
  SELECT n.capture_id, CASE WHEN n.capture_id % 4 <> 1 THEN n_reps END AS n_reps, CASE WHEN n.capture_id % 4 = 1 THEN 'squat track' END AS refusal,
    CASE WHEN n.capture_id % 4 <> 1 THEN median(pipeline_h_rms) END AS pipeline_h_rms
  FROM n LEFT JOIN pr ON pr.capture_id = n.capture_id GROUP BY n.capture_id, n_reps""", "samples reps track", places=2)
def _(spark, d):
    lifts = lifted(bounds(spark, d).select(*KEY).distinct())
    return scored(spark, d, lifts)[1]


@query("q5_truth_curves", "capture_id rep i", "ref_u ref_h pipe_u pipe_h raw_u", f"""
  WITH {_M5} SELECT capture_id, rep, i, ru AS ref_u, rhh AS ref_h, pu AS pipe_u, ph AS pipe_h, wu AS raw_u FROM cs""", "samples reps track", places=3)
def _(spark, d):
    return scored(spark, d)[2]


@query("m6_closed_referee", "capture_id rep i", "closed_u", f"""
  WITH {_M5} SELECT capture_id, rep, i, cu AS closed_u FROM cs""", "samples reps track", places=3)
def _(spark, d):
    return scored(spark, d)[2]


@query("a7_polynomial_residual", "capture_id rep", "line quad", f"""
  WITH {_DET}, u AS (SELECT capture_id, rep, x AS e, j/9.0 AS u FROM det),
  l AS (SELECT capture_id, rep, regr_slope(e, u) AS s, regr_intercept(e, u) AS c FROM u GROUP BY 1, 2),
  ln AS (SELECT capture_id, rep, sqrt(avg(pow(e - s*u - c, 2))) AS line FROM u JOIN l USING (capture_id, rep) GROUP BY 1, 2),
  o AS (SELECT capture_id, rep, e - s*u - c AS r, (u-0.5)*(u-0.5) - (1.0/12)*(11.0/9) AS q FROM u JOIN l USING (capture_id, rep))
  SELECT capture_id, rep, line, sqrt(greatest(avg(r*r) - pow(sum(r*q), 2)/sum(q*q)/count(*), 0)) AS quad FROM o JOIN ln USING (capture_id, rep) GROUP BY ALL""",
       "samples reps", places=3)
def _(spark, d):
    x = paths(spark, d).withColumn("u", F.col("j") / (F.col("stop_i") - F.col("start_i") - 1))
    a = score.polynomial_residual(x, [*KEY, "rep"], "x", "u", 1).withColumnRenamed("residual_rms", "line")
    b = score.polynomial_residual(x, [*KEY, "rep"], "x", "u", 2).withColumnRenamed("residual_rms", "quad")
    return a.join(b, [*KEY, "rep"])


@query("m8_momentum_closure", "capture_id start_i stop_i spans_impact", "dv duration_s", f"""
  WITH RECURSIVE {_PICK}, {_IMP}, iv AS (SELECT capture_id, i AS start_i, t, lead(i) OVER w AS stop_i, lead(t) OVER w AS t2 FROM picked WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  SELECT iv.capture_id, start_i, stop_i, t2 - t AS duration_s, EXISTS (SELECT 1 FROM imp WHERE imp.capture_id = iv.capture_id AND imp.i >= start_i AND imp.i < stop_i) AS spans_impact,
    (SELECT coalesce(sum((s.az + p.az)/2*(s.t - p.t)), 0) FROM samples s JOIN samples p ON p.capture_id = s.capture_id AND p.i = s.i - 1
     WHERE s.capture_id = iv.capture_id AND s.i > start_i AND s.i < stop_i) AS dv FROM iv WHERE stop_i IS NOT NULL""", "samples")
def _(spark, d):
    return score.closure_between(samples(spark, d), settle(picked(spark, d)), marks(spark, d), KEY, "az")


@query("m13_leave_one_out", "o_orderkey", "others_mean", """
  SELECT o_orderkey, CASE WHEN count(*) OVER w > 1 THEN (sum(o_totalprice) OVER w - o_totalprice)/(count(*) OVER w - 1) END AS others_mean
  FROM orders WINDOW w AS (PARTITION BY o_custkey)""", places=6)
def _(spark, d):
    return score.leave_one_out(table(spark, d, "orders"), ["o_custkey"], "o_totalprice")


@query("m15_null_scores", "capture_id rep", "start_line flat_line", f"""
  WITH {_DET} SELECT capture_id, rep, sqrt(avg(x*x)) AS start_line, stddev_pop(x) AS flat_line FROM det GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    return paths(spark, d).groupBy(*KEY, "rep").agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("start_line"), F.stddev_pop("x").alias("flat_line"))


@query("m16_spearman", "event_type points", "spearman", """
  WITH r AS (SELECT event_type, rank() OVER a + (count(*) OVER pa - 1)/2.0 AS ra, rank() OVER b + (count(*) OVER pb - 1)/2.0 AS rb FROM
    (SELECT event_type, floor(value) AS v, event_id % 97 AS k FROM events)
    WINDOW a AS (PARTITION BY event_type ORDER BY v), pa AS (PARTITION BY event_type, v), b AS (PARTITION BY event_type ORDER BY k), pb AS (PARTITION BY event_type, k))
  SELECT event_type, count(*) AS points, corr(ra, rb) AS spearman FROM r GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor("value").alias("v"), (F.col("event_id") % 97).alias("k"))
    return score.spearman(e, ["event_type"], "v", "k")


@query("m12_bootstrap_axis", "capture_id n_reps replicates", "spread_deg")
def _(spark, d):
    return score.bootstrap_axis(settle(paths(spark, d)), KEY, 40, 7, "x", "y")


# -------------------------------------------------- checks on repetitions ----


@query("v7_rep_clipping", "capture_id rep clipped ok", "", """
  WITH c AS (SELECT s.capture_id, r.rep, s.i, floor(value/50)::DOUBLE AS v FROM samples s JOIN reps r ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i),
  f AS (SELECT *, v = max(v) OVER w AS hi, v = min(v) OVER w AS lo FROM c WINDOW w AS (PARTITION BY capture_id, rep)),
  n AS (SELECT capture_id, rep, sum(k) AS k FROM (
    SELECT capture_id, rep, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY capture_id, rep ORDER BY i) AS g FROM f WHERE hi) GROUP BY capture_id, rep, g HAVING count(*) >= 2
    UNION ALL SELECT capture_id, rep, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY capture_id, rep ORDER BY i) AS g FROM f WHERE lo) GROUP BY capture_id, rep, g HAVING count(*) >= 2) GROUP BY 1, 2)
  SELECT capture_id, rep, coalesce(k, 0)::BIGINT AS clipped, coalesce(k, 0) = 0 AS ok FROM reps LEFT JOIN n USING (capture_id, rep)""", "samples reps")
def _(spark, d):
    s = samples(spark, d).withColumn("v", F.floor(F.col("value") / 50).cast("double"))
    return quality.rep_clipping(s, bounds(spark, d), KEY, ["v"])


_LIFT_SQL = "(['bench','squat','deadlift','row'])[capture_id % 4 + 1]"


def lifted(df):
    return df.withColumn("lift", F.element_at(
        F.array(*[F.lit(x) for x in ("bench", "squat", "deadlift", "row")]), (F.col("capture_id") % 4 + 1).cast("int")))


@query("v8_rom_flags", "capture_id rep rom_flag", "rom", f"""
  WITH {_DET}, r AS (SELECT capture_id, rep, (max(z) - min(z))/20 AS rom FROM det GROUP BY 1, 2)
  SELECT capture_id, rep, rom, CASE {_LIFT_SQL} WHEN 'bench' THEN CASE WHEN rom > 0.35 THEN 'above' WHEN rom < 0.20 THEN 'below' END
    WHEN 'squat' THEN CASE WHEN rom > 0.76 THEN 'above' WHEN rom < 0.45 THEN 'below' END
    WHEN 'deadlift' THEN CASE WHEN rom > 0.61 THEN 'above' WHEN rom < 0.40 THEN 'below' END END AS rom_flag FROM r""", "samples reps")
def _(spark, d):
    r = paths(spark, d).groupBy(*KEY, "rep").agg(((F.max("z") - F.min("z")) / 20).alias("rom"))
    return quality.rom_flags(lifted(r))


@query("v9_fore_aft_flags", "capture_id rep fore_aft_flag", "fore_aft_factor", f"""
  WITH {_DET}, r AS (SELECT capture_id, rep, (max(x) - min(x))/40 AS c, CASE {_LIFT_SQL} WHEN 'bench' THEN 0.1475 WHEN 'deadlift' THEN 0.0402 END AS hi FROM det GROUP BY 1, 2)
  SELECT capture_id, rep, c/hi AS fore_aft_factor, CASE WHEN hi IS NULL THEN 'refused' WHEN c > hi THEN 'above' END AS fore_aft_flag FROM r""", "samples reps")
def _(spark, d):
    r = paths(spark, d).groupBy(*KEY, "rep").agg(((F.max("x") - F.min("x")) / 40).alias("c"))
    return quality.fore_aft_flags(lifted(r))


@query("v11_axis_confidence", "capture_id reasons confident", "axis_ratio excursion", f"""
  WITH {_DET}, m AS (SELECT capture_id, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b, count(DISTINCT rep) AS k FROM det GROUP BY 1),
  e AS (SELECT *, ((a+c)/2 + sqrt(pow((a-c)/2,2) + b*b))/((a+c)/2 - sqrt(pow((a-c)/2,2) + b*b)) AS ratio, 0.5*atan2(2*b, a-c) AS th FROM m),
  s AS (SELECT capture_id, ratio, k, (max(x*cos(th)+y*sin(th)) - min(x*cos(th)+y*sin(th)))/60 AS ex FROM det JOIN e USING (capture_id) GROUP BY ALL),
  w AS (SELECT *, radians(20)*sqrt(k) AS q FROM s)
  SELECT capture_id, ratio AS axis_ratio, ex AS excursion, array_to_string(list_filter([
    CASE WHEN ratio < pow((1+sqrt(1+4*q*q))/(2*q), 2) THEN 'axis_ratio' END, CASE WHEN ex < 0.05 THEN 'excursion_small' END,
    CASE WHEN ex > 0.20 THEN 'excursion_large' END], lambda z: z IS NOT NULL), ',') AS reasons,
    NOT (ratio < pow((1+sqrt(1+4*q*q))/(2*q), 2) OR ex < 0.05 OR ex > 0.20) AS confident FROM w""", "samples reps")
def _(spark, d):
    p = settle(paths(spark, d))
    a = score.principal_axis(p, KEY, "x", "y").join(p.groupBy(*KEY).agg(F.countDistinct("rep").alias("k")), KEY)
    a = a.withColumn("excursion", F.col("excursion") / 60)
    why = rules.confidence_reasons(F.col("axis_ratio"), F.col("excursion"), F.col("k"))
    return a.withColumns({"reasons": F.array_join(why, ","), "confident": F.size(why) == 0})
