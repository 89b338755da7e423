"""Projections, windows and checks on sample rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, indexed_events, query, samples
from kinetrail.functions import geometry as geo
from kinetrail.operators import motion, quality, windows
from kinetrail.plans.blocks import runs

# ------------------------------------------------------------------ W1, W2 ---


@query("w1_spacing", "capture_id i", "dt", "SELECT capture_id, i, dt FROM samples", "samples", places=6)
def _(spark, d):
    return samples(spark, d)


@query("w2_double_integral", "capture_id i", "vx vz px pz", """
  SELECT capture_id, i, vx, vz, sum(sx) OVER w AS px, sum(sz) OVER w AS pz FROM (
    SELECT *, CASE WHEN i = 0 THEN 0 ELSE (vx + lag(vx) OVER w) / 2 * dt END AS sx,
              CASE WHEN i = 0 THEN 0 ELSE (vz + lag(vz) OVER w) / 2 * dt END AS sz FROM (
      SELECT *, sum(gx2) OVER w AS vx, sum(gz2) OVER w AS vz FROM (
        SELECT *, CASE WHEN i = 0 THEN 0 ELSE (ax + lag(ax) OVER w) / 2 * dt END AS gx2,
                  CASE WHEN i = 0 THEN 0 ELSE (az + lag(az) OVER w) / 2 * dt END AS gz2
        FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i))
      WINDOW w AS (PARTITION BY capture_id ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  WINDOW w AS (PARTITION BY capture_id ORDER BY i)""", "samples")
def _(spark, d):
    return motion.double_integral(samples(spark, d), KEY, motion.ACCEL)


@query("w2_exact_final", "capture_id v2 p4", "", """
  SELECT capture_id, CAST(max_by(v2, i) AS VARCHAR) AS v2, CAST(max_by(p4, i) AS VARCHAR) AS p4 FROM (
    SELECT *, sum(s) OVER w AS p4 FROM (
      SELECT *, CASE WHEN i = 0 THEN 0::HUGEINT ELSE (v2 + lag(v2) OVER w)::HUGEINT * h END AS s FROM (
        SELECT *, sum(g) OVER w AS v2 FROM (
          SELECT capture_id, i, us - lag(us) OVER w AS h,
            CASE WHEN i = 0 THEN 0::HUGEINT ELSE (c + lag(c) OVER w)::HUGEINT * (us - lag(us) OVER w) END AS g
          FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM base)
          WINDOW w AS (PARTITION BY capture_id ORDER BY i))
        WINDOW w AS (PARTITION BY capture_id ORDER BY i))
      WINDOW w AS (PARTITION BY capture_id ORDER BY i))
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) GROUP BY capture_id""", "base")
def _(spark, d):
    # cents and microseconds keep both integrals exact (x2 and x4)
    ev = indexed_events(spark, d).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    step = motion.spacing(ev, KEY, "us", default=0)
    got = motion.double_integral(step, KEY, ["c"], ["v2"], ["p4"], kind="decimal(38,0)")
    return got.groupBy(*KEY).agg(
        F.max_by("v2", "i").cast("string").alias("v2"), F.max_by("p4", "i").cast("string").alias("p4"))


# --------------------------------------------------------- P: projections ----
# unit quaternion rotation of (x, y, z), spelled out for the oracle
def _sql_rotate(q: tuple[str, str, str, str], v: tuple[str, str, str]) -> tuple[str, str, str]:
    w, x, y, z = q
    a, b, c = v
    cx, cy, cz = f"(2*(({y})*({c})-({z})*({b})))", f"(2*(({z})*({a})-({x})*({c})))", f"(2*(({x})*({b})-({y})*({a})))"
    return (
        f"(({a})+({w})*{cx}+(({y})*{cz}-({z})*{cy}))",
        f"(({b})+({w})*{cy}+(({z})*{cx}-({x})*{cz}))",
        f"(({c})+({w})*{cz}+(({x})*{cy}-({y})*{cx}))",
    )


_Q = ("qw", "qx", "qy", "qz")
_INV = ("qw", "(-qx)", "(-qy)", "(-qz)")


@query("p1_magnitude", "capture_id i", "accel gyro", """
  SELECT capture_id, i, sqrt(ax*ax+ay*ay+az*az) AS accel, sqrt(gx*gx+gy*gy+gz*gz) AS gyro FROM samples""", "samples")
def _(spark, d):
    return samples(spark, d).withColumns({
        "accel": motion.magnitude(motion.ACCEL), "gyro": motion.magnitude(motion.GYRO)})


_fx, _fy, _fz = _sql_rotate(_Q, ("ax", "ay", "az"))
_bx, _by, _bz = _sql_rotate(_INV, ("ax", "ay", "az"))


@query("p2_rotations", "capture_id i", "fx fy fz rx ry rz angle mw mx", f"""
  SELECT capture_id, i, {_fx} AS fx, {_fy} AS fy, {_fz} AS fz, {_bx} AS rx, {_by} AS ry, {_bz} AS rz,
    2*atan2(sqrt(qx*qx+qy*qy+qz*qz), abs(qw)) AS angle,
    qw*cos(h) - (qx*gx+qy*gy+qz*gz)*s AS mw, qw*gx*s + cos(h)*qx + (qy*gz-qz*gy)*s AS mx
  FROM (SELECT *, sqrt(gx*gx+gy*gy+gz*gz)/2 AS h,
    CASE WHEN gx*gx+gy*gy+gz*gz < 1e-16 THEN 0.5 ELSE sin(sqrt(gx*gx+gy*gy+gz*gz)/2)/sqrt(gx*gx+gy*gy+gz*gz) END AS s
    FROM samples)""", "samples")
def _(spark, d):
    q, a, g = geo.unit(geo.cols(*_Q)), geo.cols(*motion.ACCEL), geo.cols(*motion.GYRO)
    f, b = geo.rotate(q, a), geo.rotate(geo.inverse(q), a)
    m = geo.multiply(q, geo.exponential(g))
    return samples(spark, d).withColumns({
        "fx": f[0], "fy": f[1], "fz": f[2], "rx": b[0], "ry": b[1], "rz": b[2],
        "angle": geo.rotation_angle(q), "mw": m[0], "mx": m[1]})


_BIAS = (0.02, -0.01, 0.03)
_BN = sum(b * b for b in _BIAS) ** 0.5


@query("p3_attitude_bias", "capture_id i", "cw cx cy cz", f"""
  SELECT capture_id, i, qw*c + s*(qx*{_BIAS[0]}+qy*({_BIAS[1]})+qz*{_BIAS[2]}) AS cw,
    -qw*s*{_BIAS[0]} + c*qx - s*(qy*{_BIAS[2]} - qz*({_BIAS[1]})) AS cx,
    -qw*s*({_BIAS[1]}) + c*qy - s*(qz*{_BIAS[0]} - qx*{_BIAS[2]}) AS cy,
    -qw*s*{_BIAS[2]} + c*qz - s*(qx*({_BIAS[1]}) - qy*{_BIAS[0]}) AS cz
  FROM (SELECT *, cos(t*{_BN}/2) AS c, CASE WHEN t = 0 THEN 0 ELSE sin(t*{_BN}/2)/{_BN} END AS s FROM samples)""",
       "samples")
def _(spark, d):
    return motion.correct_attitude(samples(spark, d), _BIAS)


_g0 = _sql_rotate(_INV, ("0", "0", "(-9.80665)"))
_w = _sql_rotate(("cw", "cx", "cy", "cz"), ("hx", "hy", "hz"))


@query("p4_world_acceleration", "capture_id i", "wx wy wz", f"""
  SELECT capture_id, i, {_w[0]} AS wx, {_w[1]} AS wy, {_w[2]} - 9.80665 AS wz FROM (
    SELECT capture_id, i, ax - {_g0[0]} AS hx, ay - {_g0[1]} AS hy, az - {_g0[2]} AS hz,
      qw AS cw, qx AS cx, qy AS cy, qz AS cz FROM samples)""", "samples")
def _(spark, d):
    return motion.to_world(samples(spark, d))


_arm = {lift: _sql_rotate(_Q, tuple(str(x) for x in off)) for lift, off in (
    ("bench", (-0.09, 0.0, 0.03)), ("squat", (-0.05, 0.0, -0.04)))}


@query("p5_lever_arm", "capture_id i", "ox oy oz", f"""
  SELECT capture_id, i,
    ax - CASE capture_id % 4 WHEN 0 THEN {_arm['bench'][0]} WHEN 1 THEN {_arm['squat'][0]} WHEN 2 THEN {_arm['bench'][0]} ELSE 0 END AS ox,
    ay - CASE capture_id % 4 WHEN 0 THEN {_arm['bench'][1]} WHEN 1 THEN {_arm['squat'][1]} WHEN 2 THEN {_arm['bench'][1]} ELSE 0 END AS oy,
    az - CASE capture_id % 4 WHEN 0 THEN {_arm['bench'][2]} WHEN 1 THEN {_arm['squat'][2]} WHEN 2 THEN {_arm['bench'][2]} ELSE 0 END AS oz
  FROM samples""", "samples")
def _(spark, d):
    lift = F.element_at(F.array(F.lit("bench"), F.lit("squat"), F.lit("deadlift"), F.lit("row")),
                        (F.col("capture_id") % 4 + 1).cast("int"))
    return motion.wrist_offset(samples(spark, d).withColumn("lift", lift), position=motion.ACCEL, out=("ox", "oy", "oz"))


@query("p6_plane_projection", "capture_id i", "u h", """
  SELECT capture_id, i, (ax*axis_x + ay*axis_y)/sqrt(axis_x*axis_x+axis_y*axis_y) AS u, az AS h FROM (
    SELECT *, 1.0 + capture_id % 3 AS axis_x, 2.0 - capture_id % 5 AS axis_y FROM samples)""", "samples")
def _(spark, d):
    k = F.col("capture_id")
    s = samples(spark, d).withColumns({"axis_x": F.lit(1.0) + k % 3, "axis_y": F.lit(2.0) - k % 5})
    return motion.project(s, position=motion.ACCEL)


@query("p11_angle_unwrap", "capture_id i", "unwrapped", """
  SELECT capture_id, i, sum(step) OVER w AS unwrapped FROM (
    SELECT capture_id, i, coalesce(atan2(sin(a - lag(a) OVER w), cos(a - lag(a) OVER w)), a) AS step
    FROM (SELECT *, (event_id % 628) / 100.0 - 3.14 AS a FROM samples) WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  WINDOW w AS (PARTITION BY capture_id ORDER BY i)""", "samples")
def _(spark, d):
    s = samples(spark, d).withColumn("a", (F.col("event_id") % 628) / 100.0 - 3.14)
    return motion.unwrap(s, KEY, "a")


@query("p11_circular_spread", "capture_id", "spread", """
  SELECT capture_id, degrees(sqrt(greatest(-2*ln(greatest(sqrt(c*c+s*s), 1e-12)), 0)))/2 AS spread FROM (
    SELECT capture_id, avg(cos(2*radians((event_id % 360)::DOUBLE))) AS c, avg(sin(2*radians((event_id % 360)::DOUBLE))) AS s
    FROM samples GROUP BY capture_id)""", "samples")
def _(spark, d):
    angle = (F.col("event_id") % 360).cast("double")
    return samples(spark, d).groupBy(*KEY).agg(geo.circular_spread_180(angle).alias("spread"))


def _sql_multiply(p: tuple[str, ...], q: tuple[str, ...]) -> tuple[str, ...]:
    (a, b, c, e), (w, x, y, z) = p, q
    return (f"({a}*{w} - {b}*{x} - {c}*{y} - {e}*{z})", f"({a}*{x} + {b}*{w} + {c}*{z} - {e}*{y})",
            f"({a}*{y} - {b}*{z} + {c}*{w} + {e}*{x})", f"({a}*{z} + {b}*{y} - {c}*{x} + {e}*{w})")


_TILT_N, _GREF_N = math.hypot(0.001, 0.002), math.hypot(0.0005, 0.0002)
_tilt = tuple(repr(v) for v in (math.cos(_TILT_N / 2), math.sin(_TILT_N / 2) * 0.001 / _TILT_N, math.sin(_TILT_N / 2) * 0.002 / _TILT_N, 0.0))
_first = _sql_multiply(_tilt, _Q)
_both = _sql_multiply(("gw", "ge", "0", "gu"), ("tw", "tx", "ty", "tz"))
_turned = _sql_rotate(("mw", "mx", "my", "mz"), ("hx", "hy", "hz"))


@query("p12_error_model", "capture_id i", "wx wy wz", f"""
  SELECT capture_id, i, {_turned[0]} AS wx, {_turned[1]} AS wy, {_turned[2]} - 9.80665 AS wz FROM (
    SELECT capture_id, i, hx, hy, hz, {_both[0]} AS mw, {_both[1]} AS mx, {_both[2]} AS my, {_both[3]} AS mz FROM (
      SELECT capture_id, i, ax*1.01 + 0.02 - {_g0[0]} AS hx, ay*0.99 - {_g0[1]} AS hy, az*1.02 - 0.01 - {_g0[2]} AS hz,
        {_first[0]} AS tw, {_first[1]} AS tx, {_first[2]} AS ty, {_first[3]} AS tz, cos({_GREF_N}*size/2) AS gw,
        sin({_GREF_N}*size/2)*{0.0005 / _GREF_N} AS ge, sin({_GREF_N}*size/2)*{0.0002 / _GREF_N} AS gu
      FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS size FROM samples)))""", "samples")
def _(spark, d):
    return motion.error_model(samples(spark, d), {
        "scale": (0.01, -0.01, 0.02), "bias": (0.02, 0.0, -0.01), "tilt": (0.001, 0.002, 0.0),
        "gravref": (0.0005, 0.0, 0.0002)})


# ------------------------------------------------------------- V: checks -----


@query("v1_irregular_sampling", "capture_id irregular", "dt_cv", """
  SELECT capture_id, stddev_pop(dt)/avg(dt) AS dt_cv, stddev_pop(dt)/avg(dt) > 0.15 AS irregular
  FROM samples WHERE i > 0 GROUP BY capture_id""", "samples")
def _(spark, d):
    return quality.irregular_sampling(samples(spark, d), KEY)


@query("v2_quaternion_norm", "capture_id not_unit", "norm_error", """
  SELECT capture_id, max(abs(sqrt(qw*qw+qx*qx+qy*qy+qz*qz)-1)) AS norm_error,
    max(abs(sqrt(qw*qw+qx*qx+qy*qy+qz*qz)-1)) > 1e-3 AS not_unit FROM (
    SELECT capture_id, qw * (1 + (event_id % 3)/1000.0) AS qw, qx, qy, qz FROM samples) GROUP BY capture_id""", "samples")
def _(spark, d):
    s = samples(spark, d).withColumn("qw", F.col("qw") * (1 + (F.col("event_id") % 3) / 1000.0))
    return quality.quaternion_norm(s, KEY)


_COARSE = """coarse AS (SELECT capture_id, i, n, fs, t, floor(value / 100)::DOUBLE AS ax,
  (event_id % 2)::DOUBLE AS ay, 1.0::DOUBLE AS az FROM rated)"""


def coarse(spark, d):
    """Few-valued channels, so that rails and runs occur."""
    return samples(spark, d).withColumns({
        "ax": F.floor(F.col("value") / 100).cast("double"), "ay": (F.col("event_id") % 2).cast("double"),
        "az": F.lit(1.0)})


_CLIP_SQL = """
  SELECT k.capture_id, coalesce(sum(c), 0)::BIGINT AS clipped FROM (SELECT DISTINCT capture_id FROM rails) k LEFT JOIN (
    SELECT capture_id, rail, island, count(*) AS c FROM (
      SELECT capture_id, rail, i - row_number() OVER (PARTITION BY capture_id, rail ORDER BY i) AS island
      FROM rails WHERE hit) GROUP BY ALL HAVING count(*) >= 2) USING (capture_id) GROUP BY 1"""
_RAILS = """rails AS (
  SELECT capture_id, i, rail, v = CASE WHEN rail LIKE 'max%' THEN hi ELSE lo END AS hit FROM (
    SELECT capture_id, i, u.rail, CASE right(u.rail, 2) WHEN 'ax' THEN ax WHEN 'ay' THEN ay ELSE az END AS v,
      CASE right(u.rail, 2) WHEN 'ax' THEN max(ax) OVER k WHEN 'ay' THEN max(ay) OVER k ELSE max(az) OVER k END AS hi,
      CASE right(u.rail, 2) WHEN 'ax' THEN min(ax) OVER k WHEN 'ay' THEN min(ay) OVER k ELSE min(az) OVER k END AS lo
    FROM coarse, (SELECT unnest(['max_ax','min_ax','max_ay','min_ay','max_az','min_az']) AS rail) u
    WINDOW k AS (PARTITION BY capture_id)))"""


@query("v3_clipped_samples", "capture_id clipped", "", f"WITH {_COARSE}, {_RAILS} {_CLIP_SQL}", "rated")
def _(spark, d):
    return quality.clipped_samples(coarse(spark, d), KEY)


@query("v4_closing_hold", "capture_id no_hold", "held_s tail_rate", """
  SELECT capture_id, held_s, tail_rate, coalesce(held_s < 2.0, tail_rate > 0.05, false) AS no_hold FROM (
    SELECT capture_id, CASE WHEN count(ph) = max(n) THEN count(*) FILTER (WHERE ph = 2) / greatest(max(fs), 1.0) END AS held_s,
      CASE WHEN count(ph) <> max(n) AND max(n) > 1 AND max(t) > 5.0
        THEN avg(sqrt(gx*gx+gy*gy+gz*gz)) FILTER (WHERE t > tend - 2.0) END AS tail_rate
    FROM (SELECT *, CASE WHEN capture_id % 2 = 0 OR event_id % 50 > 0 THEN phase END AS ph,
      max(t) OVER (PARTITION BY capture_id) AS tend FROM rated) GROUP BY capture_id)""", "rated")
def _(spark, d):
    s = samples(spark, d).withColumn(
        "phase", F.when((F.col("capture_id") % 2 == 0) | (F.col("event_id") % 50 > 0), F.col("phase")))
    return quality.closing_hold(s, KEY)


@query("v5_brief_transients", "capture_id brief", "peak_g", """
  SELECT capture_id, count(*) FILTER (WHERE len IS NOT NULL AND len < greatest(50.0 * fs / 1000.0, 2.0)) AS brief, max(peak_g) AS peak_g
  FROM (SELECT capture_id, max(fs) AS fs, max(sqrt(ax*ax+ay*ay+az*az)/9.80665) AS peak_g FROM rated GROUP BY 1) p
  LEFT JOIN (SELECT capture_id, count(*) AS len FROM (
    SELECT capture_id, i - row_number() OVER (PARTITION BY capture_id ORDER BY i) AS island FROM samples
    WHERE sqrt(ax*ax+ay*ay+az*az)/9.80665 > 0.45) GROUP BY capture_id, island) USING (capture_id) GROUP BY capture_id""",
       "rated")
def _(spark, d):
    return quality.brief_transients(samples(spark, d), KEY, threshold_g=0.45)


@query("v6_findings", "capture_id rule severity", "value", f"""
  WITH {_COARSE}, {_RAILS}, clips AS ({_CLIP_SQL})
  SELECT capture_id, 'irregular_sampling' AS rule, 'warning' AS severity, v AS value FROM (
    SELECT capture_id, stddev_pop(dt)/avg(dt) AS v FROM samples WHERE i > 0 GROUP BY 1) WHERE v > 0.15
  UNION ALL SELECT capture_id, 'clipped', 'warning', clipped::DOUBLE FROM clips WHERE clipped > 0
  UNION ALL SELECT capture_id, 'no_closing_hold', 'warning', v FROM (
    SELECT capture_id, count(*) FILTER (WHERE phase = 2) / greatest(max(fs), 1.0) AS v FROM rated GROUP BY 1) WHERE v < 2.0
  UNION ALL SELECT capture_id, 'brief_transients', 'warning', count(*)::DOUBLE FROM (
    SELECT capture_id, count(*) AS len, max(fs) AS fs FROM (
      SELECT capture_id, fs, i - row_number() OVER (PARTITION BY capture_id ORDER BY i) AS island FROM coarse
      WHERE sqrt(ax*ax+ay*ay+az*az)/9.80665 > 8.0) GROUP BY capture_id, island)
    WHERE len < greatest(50.0 * fs / 1000.0, 2.0) GROUP BY capture_id""", "rated")
def _(spark, d):
    return quality.findings(coarse(spark, d), KEY)


# ------------------------------------------------------------- W: windows ----


@query("w3_rolling_variance", "capture_id i", "var", """
  SELECT a.capture_id, a.i, greatest(avg(b.value*b.value) - avg(b.value)*avg(b.value), 0) AS var
  FROM (SELECT *, greatest(round_even(1.0*fs, 0)::BIGINT, 3) AS w FROM rated) a,
    LATERAL (SELECT unnest(range(a.i - a.w // 2, a.i - a.w // 2 + a.w)) AS p) r
  JOIN samples b ON b.capture_id = a.capture_id AND b.i = least(greatest(r.p, 0), a.n - 1)
  GROUP BY a.capture_id, a.i""", "rated", places=2)
def _(spark, d):
    return windows.rolling_variance(
        samples(spark, d), KEY, {"var": F.col("value")}, windows.frame_rows(1.0, 3))


_FILLED = """filled AS (
  SELECT capture_id, i, n, t, CASE WHEN b IS NULL THEN nv WHEN nx IS NULL THEN bv WHEN b = nx THEN bv
    ELSE bv + (nv - bv) * (i - b) / (nx - b) END AS v FROM (
    SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER p AS b, min(CASE WHEN x IS NOT NULL THEN i END) OVER f AS nx,
      last_value(x IGNORE NULLS) OVER p AS bv, first_value(x IGNORE NULLS) OVER f AS nv FROM (
      SELECT capture_id, i, n, t, CASE WHEN event_id % 10 <> 1 THEN value END AS x FROM samples)
    WINDOW p AS (PARTITION BY capture_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY capture_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


@query("w4_smooth", "capture_id i", "smoothed", f"""
  WITH {_FILLED} SELECT a.capture_id, a.i, avg(b.v) AS smoothed FROM filled a, (SELECT unnest(range(-4, 5)) AS o)
  JOIN filled b ON b.capture_id = a.capture_id AND b.i = least(greatest(a.i + o, 0), a.n - 1) GROUP BY ALL""", "samples")
def _(spark, d):
    s = samples(spark, d).withColumn("x", F.when(F.col("event_id") % 10 != 1, F.col("value")))
    return windows.smooth(s, KEY, "x", "smoothed", 9)


_STILL = """still AS (
  SELECT capture_id, CASE WHEN e <= w THEN 0 ELSE best END AS start_i, CASE WHEN e <= w THEN greatest(e, w) ELSE best + w END AS stop_i
  FROM (SELECT capture_id, count(*) FILTER (WHERE t < 3.0) AS e, greatest(round_even(1.0*max(fs), 0)::BIGINT, 5) AS w FROM rated GROUP BY 1) k
  LEFT JOIN (SELECT capture_id, arg_min(i, struct_pack(var := round(var, 9) + 0.0, i := i)) AS best FROM (
    SELECT a.capture_id, a.i, avg(b.m*b.m) - avg(b.m)*avg(b.m) AS var FROM
      (SELECT *, greatest(round_even(1.0*fs, 0)::BIGINT, 5) AS w, count(*) FILTER (WHERE t < 3.0) OVER (PARTITION BY capture_id) AS e FROM rated) a
      JOIN (SELECT capture_id, i, sqrt(gx*gx+gy*gy+gz*gz) AS m FROM samples) b
        ON b.capture_id = a.capture_id AND b.i >= a.i AND b.i < a.i + a.w
      WHERE a.i <= a.e - a.w AND a.t < 3.0 GROUP BY a.capture_id, a.i) GROUP BY capture_id) USING (capture_id))"""


@query("w5_stillest_window", "capture_id start_i stop_i", "", f"WITH {_STILL} SELECT * FROM still", "rated")
def _(spark, d):
    return windows.stillest_window(samples(spark, d), KEY)


_HOLDS = """holds AS (
  SELECT capture_id, hold, arg_min(k, struct_pack(s := round(s, 9) + 0.0, k := k)) AS start_k, max(len) AS len FROM (
    SELECT a.capture_id, a.hold, a.k, a.len, avg(b.m) AS s FROM ranked a JOIN ranked b
      ON a.capture_id = b.capture_id AND a.hold = b.hold AND b.k >= a.k AND b.k < a.k + a.len
    WHERE a.size >= a.len + 2 AND a.k <= a.size - a.len GROUP BY ALL) GROUP BY 1, 2),
  held AS (SELECT ranked.*, start_k FROM ranked JOIN holds USING (capture_id, hold) WHERE k >= start_k AND k < start_k + holds.len)"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, hold ORDER BY i) - 1 AS k,
    count(*) OVER (PARTITION BY capture_id, hold) AS size, floor(1.5 * fs)::BIGINT AS len FROM (
    SELECT *, CASE phase WHEN 0 THEN 'open' WHEN 2 THEN 'close' END AS hold, sqrt(gx*gx+gy*gy+gz*gz) AS m FROM rated) WHERE hold IS NOT NULL)"""


@query("w6_hold_windows", "capture_id hold i start_k", "", f"""
  WITH {_RANKED}, {_HOLDS} SELECT capture_id, hold, i, start_k FROM held""", "rated")
def _(spark, d):
    return windows.hold_windows(samples(spark, d), KEY)


@query("w7_quietest_slide", "capture_id", "start_t spread", """
  SELECT capture_id, arg_min(lo, struct_pack(s := round(s*s, 9) + 0.0, lo := lo)) AS start_t, min(s) AS spread FROM (
    SELECT a.capture_id, lo, stddev_pop(sqrt(gx*gx+gy*gy+gz*gz)) AS s FROM
      (SELECT capture_id, max(t) AS tend FROM samples GROUP BY 1) a,
      LATERAL (SELECT unnest(range(0, (2*greatest(tend - 8.0, 0.1))::BIGINT + 2)) * 0.5 AS lo) g
      JOIN samples b ON b.capture_id = a.capture_id AND b.t >= lo AND b.t < lo + 8.0
    WHERE lo < greatest(tend - 8.0, 0.1) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY capture_id""", "samples")
def _(spark, d):
    return windows.quietest_slide(samples(spark, d), KEY, motion.magnitude(motion.GYRO))


@query("w8_runs", "capture_id start_i stop_i len", "", """
  SELECT capture_id, min(i) AS start_i, max(i) + 1 AS stop_i, count(*) AS len FROM (
    SELECT capture_id, i, i - row_number() OVER (PARTITION BY capture_id ORDER BY i) AS island FROM samples WHERE value > 50)
  GROUP BY capture_id, island""", "samples")
def _(spark, d):
    return runs(samples(spark, d), KEY, F.col("value") > 50)


_LOBES = """lobed AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w AS run, CASE WHEN same THEN (s + ps)/2*(t - pt) ELSE 0 END AS slab FROM (
    SELECT *, coalesce((s >= 0) = (ps >= 0), false) AS same FROM (
      SELECT capture_id, i, t, value - 40 AS s, lag(value - 40) OVER w AS ps, lag(t) OVER w AS pt FROM samples
      WINDOW w AS (PARTITION BY capture_id ORDER BY i)))
  WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  lobes AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_i) - 1 AS lobe FROM (
    SELECT capture_id, min(i) AS start_i, max(i) + 1 AS stop_i, sum(slab) AS area, max(abs(s)) AS peak,
      CASE WHEN sum(slab) > 0 THEN arg_min(i, struct_pack(v := -s, i := i)) ELSE arg_min(i, struct_pack(v := s, i := i)) END AS peak_i,
      CASE WHEN sum(slab) > 0 THEN arg_min(t, struct_pack(v := -s, i := i)) ELSE arg_min(t, struct_pack(v := s, i := i)) END AS peak_t
    FROM lobed GROUP BY capture_id, run) WHERE stop_i - start_i >= 2 AND abs(area) >= 5)"""


def lobe_rows(spark, d):
    s = samples(spark, d).withColumn("s", F.col("value") - 40)
    return windows.lobes(s, KEY, "s", min_area=5.0, min_rows=2)


@query("w9_sign_lobes", "capture_id lobe start_i stop_i peak_i", "peak_t area peak",
       f"WITH {_LOBES} SELECT * FROM lobes", "samples")
def _(spark, d):
    return lobe_rows(spark, d)


@query("w10_local_maxima", "capture_id i", "value", """
  SELECT capture_id, i, value FROM (SELECT *, value >= lag(value) OVER w AND value >= lead(value) OVER w AS p FROM samples
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)) WHERE p AND value > 60""", "samples")
def _(spark, d):
    return windows.local_maxima(samples(spark, d), KEY, "value", F.col("value") > 60)


@query("w14_dwells", "capture_id start_i stop_i", "mid", """
  SELECT capture_id, min(i) AS start_i, max(i) + 1 AS stop_i, (min(t) + max(t)) * 0.5 AS mid FROM (
    SELECT capture_id, i, t, i - row_number() OVER (PARTITION BY capture_id ORDER BY i) AS island FROM samples WHERE abs(ax) < 3.0)
  GROUP BY capture_id, island HAVING max(t) - min(t) >= 0.2""", "samples")
def _(spark, d):
    return windows.dwells(samples(spark, d), KEY, "ax", slow=3.0)


@query("w15_gradient", "capture_id i", "slope", """
  SELECT capture_id, i, CASE WHEN pt IS NULL THEN (nv - value)/(nt - t) WHEN nt IS NULL THEN (value - pv)/(t - pt) ELSE
    ((t-pt)*(t-pt)*nv + ((nt-t)*(nt-t) - (t-pt)*(t-pt))*value - (nt-t)*(nt-t)*pv) / ((t-pt)*(nt-t)*(nt-pt)) END AS slope FROM (
    SELECT capture_id, i, t, value, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lag(value) OVER w AS pv, lead(value) OVER w AS nv
    FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i))""", "samples", places=2)
def _(spark, d):
    return windows.gradient(samples(spark, d), KEY, "value", "slope")


_SG = [-21, 14, 39, 54, 59, 54, 39, 14, -21]


def _cubic_ends() -> str:
    """Value at row x of the cubic fitted to the nine rows of an end, in SQL.

    Over z = -4 .. 4 the sums of z^2, z^4 and z^6 are 60, 708 and 9780, so the
    even and odd coefficients are two 2 x 2 systems."""
    return """ends AS (
      SELECT capture_id, e, (708*s0 - 60*s2)/2772.0 AS c0, (9*s2 - 60*s0)/2772.0 AS c2, (9780*s1 - 708*s3)/85536.0 AS c1, (60*s3 - 708*s1)/85536.0 AS c3 FROM (
        SELECT capture_id, e, sum(value) AS s0, sum(value*z) AS s1, sum(value*z*z) AS s2, sum(value*z*z*z) AS s3 FROM (
          SELECT capture_id, 0 AS e, value, i - 4 AS z FROM samples WHERE i < 9 AND n >= 9 UNION ALL
          SELECT capture_id, 1, value, i - (n - 5) FROM samples WHERE i >= n - 9 AND n >= 9) GROUP BY 1, 2))"""


@query("w16_polynomial_smooth", "capture_id i", "smoothed", f"WITH {_cubic_ends()}, mid AS (SELECT capture_id, i, n, (" + " + ".join(
    f"({c})*{'lag' if k < 4 else 'lead'}(value, {abs(k - 4)}) OVER w" for k, c in enumerate(_SG)) + """) / 231.0 AS smoothed
  FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i))
  SELECT m.capture_id, m.i, CASE WHEN n < 9 THEN NULL WHEN m.i < 4 OR m.i >= n - 4 THEN c0 + c1*z + c2*z*z + c3*z*z*z ELSE smoothed END AS smoothed
  FROM (SELECT *, CASE WHEN i < 4 THEN 0 ELSE 1 END AS e, CASE WHEN i < 4 THEN i - 4 ELSE i - (n - 5) END AS z FROM mid) m LEFT JOIN ends USING (capture_id, e)""", "samples")
def _(spark, d):
    return windows.polynomial_smooth(samples(spark, d), KEY, "value", "smoothed")


@query("w17_zero_phase_band", "capture_id i", "banded")
def _(spark, d):
    from kinetrail.plans.scans import zero_phase_band

    return zero_phase_band(samples(spark, d), KEY, "value", "banded", 0.12, 1.0)


@query("v16_stationary_mask", "capture_id i still", "", """
  WITH quiet AS (SELECT capture_id, i, max(fs) AS fs, greatest(avg(b.m*b.m) - avg(b.m)*avg(b.m), 0) < 3.0
      AND greatest(avg(b.g*b.g) - avg(b.g)*avg(b.g), 0) < 0.004 AS q FROM (
    SELECT a.capture_id, a.i, a.fs, bm.m, bm.g FROM (SELECT *, greatest(round_even(0.5*fs, 0)::BIGINT, 3) AS w FROM rated) a,
      LATERAL (SELECT unnest(range(a.i - a.w // 2, a.i - a.w // 2 + a.w)) AS p) r
      JOIN (SELECT capture_id, i, sqrt(ax*ax+ay*ay+az*az) AS m, sqrt(gx*gx+gy*gy+gz*gz) AS g FROM samples) bm
        ON bm.capture_id = a.capture_id AND bm.i = least(greatest(r.p, 0), a.n - 1)) b GROUP BY capture_id, i),
  isl AS (SELECT *, i - row_number() OVER (PARTITION BY capture_id, q ORDER BY i) AS island FROM quiet)
  SELECT capture_id, i, q AND count(*) OVER (PARTITION BY capture_id, q, island) >= round_even(0.3*fs, 0) AS still FROM isl""", "rated")
def _(spark, d):
    return windows.stationary_mask(
        samples(spark, d), KEY, motion.magnitude(motion.ACCEL), motion.magnitude(motion.GYRO),
        window_s=0.5, accel_var_max=3.0, gyro_var_max=0.004, min_s=0.3)
