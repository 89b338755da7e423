"""Events, joins, aggregates and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, detections, indexed_events, query, reps, samples, table, track
from kinetrail.catalog.signals import _LOBES, lobe_rows
from kinetrail.operators import events, motion, score, segment, sync, windows
from kinetrail.plans.blocks import BLOCK, index_series, lookup, neighbours, ordinal, per_key, reblock, runs
from kinetrail.plans.joins import interpolate, interval_join, overlap_join, time_range_join
from kinetrail.plans.quantiles import exact_quantiles
from kinetrail.plans.scans import refractory, tile_products

HOT = 60.0
_HOT_G = 0.35

# the events of interest in most queries: samples with a high value, quiet for
# 0.4 time units after each accepted one
_PICK = f"""cand AS (SELECT capture_id, i, n, t, row_number() OVER (PARTITION BY capture_id ORDER BY i) AS r
    FROM samples WHERE value > {HOT}),
  walk AS (SELECT capture_id, r, i, n, t, t AS last, true AS hit FROM cand WHERE r = 1
    UNION ALL SELECT c.capture_id, c.r, c.i, c.n, c.t, CASE WHEN c.t - w.last > 0.4 THEN c.t ELSE w.last END, c.t - w.last > 0.4
    FROM walk w JOIN cand c ON c.capture_id = w.capture_id AND c.r = w.r + 1),
  picked AS (SELECT capture_id, i, n, t FROM walk WHERE hit)"""


def picked(spark, d):
    s = samples(spark, d).filter(F.col("value") > HOT)
    return refractory(s.select(*KEY, "i", "n", BLOCK, "t"), KEY, "t", 0.4)


@query("w12_refractory_events", "capture_id i", "t", f"WITH RECURSIVE {_PICK} SELECT * FROM picked", "samples")
def _(spark, d):
    return picked(spark, d)


@query("w12_impacts", "capture_id i", "t mag", f"""
  WITH RECURSIVE cand AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY i) AS r FROM (
      SELECT capture_id, i, t, sqrt(ax*ax+ay*ay+az*az)/9.80665 AS mag, fs FROM rated) WHERE i >= floor(1.0*fs) AND mag > {_HOT_G}),
    walk AS (SELECT capture_id, r, i, t, mag, t AS last, true AS hit FROM cand WHERE r = 1
      UNION ALL SELECT c.capture_id, c.r, c.i, c.t, c.mag, CASE WHEN c.t - w.last > 0.5 THEN c.t ELSE w.last END, c.t - w.last > 0.5
      FROM walk w JOIN cand c ON c.capture_id = w.capture_id AND c.r = w.r + 1)
  SELECT capture_id, i, t, mag FROM walk WHERE hit""", "rated")
def _(spark, d):
    return events.impacts(samples(spark, d), KEY, threshold_g=_HOT_G, gap_s=0.5, skip_s=1.0)


@query("w11_landings", "clip_id i", "t", """
  WITH RECURSIVE falls AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS r FROM (
      SELECT clip_id, i, t, height < 0.3 AND NOT coalesce(lag(height) OVER w < 0.3, false) AND lag(i) OVER w IS NOT NULL AS fall
      FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY i)) WHERE fall AND t > 2.0),
    walk AS (SELECT clip_id, r, i, t, t AS last, true AS hit FROM falls WHERE r = 1
      UNION ALL SELECT c.clip_id, c.r, c.i, c.t, CASE WHEN c.t - w.last > 0.8 THEN c.t ELSE w.last END, c.t - w.last > 0.8
      FROM walk w JOIN falls c ON c.clip_id = w.clip_id AND c.r = w.r + 1)
  SELECT clip_id, i, t FROM walk WHERE hit""", "track")
def _(spark, d):
    return events.landings(track(spark, d), ["clip_id"], floor_m=0.3, gap_s=0.8, skip_s=2.0)


_REST = """scored AS (SELECT v.*, v.av/(m.ma + 1e-12) + v.gv/(m.mg + 1e-12) AS score FROM roll v JOIN (
    SELECT capture_id, median(av) AS ma, median(gv) AS mg FROM roll GROUP BY 1) m USING (capture_id)),
  rests AS (SELECT capture_id, impact_i, arg_min(struct_pack(i := i, t := t, m := mean_mag), struct_pack(s := score, i := i)) AS r FROM (
    SELECT p.i AS impact_i, s.* FROM picked p JOIN scored s ON s.capture_id = p.capture_id AND s.t >= p.t AND s.t < p.t + 0.5 AND s.i >= p.i)
    GROUP BY 1, 2)"""
_ROLL = """roll AS (SELECT a.capture_id, a.i, a.t,
    greatest(avg(b.m*b.m) FILTER (WHERE kind = 'v') - avg(b.m) FILTER (WHERE kind = 'v') * avg(b.m) FILTER (WHERE kind = 'v'), 0) AS av,
    greatest(avg(b.g*b.g) FILTER (WHERE kind = 'v') - avg(b.g) FILTER (WHERE kind = 'v') * avg(b.g) FILTER (WHERE kind = 'v'), 0) AS gv,
    avg(b.m) FILTER (WHERE kind = 'm') AS mean_mag
  FROM (SELECT *, greatest(round_even(0.5*fs, 0)::BIGINT, 3) AS w FROM rated) a,
    LATERAL (SELECT 'v' AS kind, unnest(range(a.i - a.w // 2, a.i - a.w // 2 + a.w)) AS p
      UNION ALL SELECT 'm', unnest(range(greatest(a.i - a.w, 0), least(a.i + a.w, a.n)))) r
  JOIN (SELECT capture_id, i, sqrt(ax*ax+ay*ay+az*az) AS m, sqrt(gx*gx+gy*gy+gz*gz) AS g FROM samples) b
    ON b.capture_id = a.capture_id AND b.i = least(greatest(r.p, 0), a.n - 1) GROUP BY a.capture_id, a.i, a.t)"""


def rests(spark, d):
    return events.rest_instants(samples(spark, d), picked(spark, d), KEY, look_s=0.5, max_accel=4.2, window_s=0.5)


@query("w13_rest_instants", "capture_id impact_i i", "t", f"""
  WITH RECURSIVE {_PICK}, {_ROLL}, {_REST} SELECT capture_id, impact_i, r.i AS i, r.t AS t FROM rests WHERE r.m <= 4.2""", "rated")
def _(spark, d):
    return rests(spark, d)


@query("w18_neighbour_gaps", "capture_id i prev_i", "gap", f"""
  WITH RECURSIVE {_PICK} SELECT capture_id, i, lag(i) OVER w AS prev_i, t - lag(t) OVER w AS gap FROM picked
  WINDOW w AS (PARTITION BY capture_id ORDER BY i)""", "samples")
def _(spark, d):
    return events.gaps(picked(spark, d), KEY)


@query("w19_cumulative_between", "capture_id rep", "gain", """
  SELECT r.capture_id, r.rep, b.c - a.c AS gain FROM reps r
  JOIN (SELECT capture_id, i, sum(value) OVER (PARTITION BY capture_id ORDER BY i) AS c FROM base) a
    ON a.capture_id = r.capture_id AND a.i = r.start_i
  JOIN (SELECT capture_id, i, sum(value) OVER (PARTITION BY capture_id ORDER BY i) AS c FROM base) b
    ON b.capture_id = r.capture_id AND b.i = r.stop_i - 1""", "reps")
def _(spark, d):
    from kinetrail.plans.blocks import prefix

    c = prefix(samples(spark, d), KEY, {"c": ("sum", "value")})
    ends = interval_join(c.select(*KEY, "i", BLOCK, "c"), reps(spark, d).drop("n", BLOCK), KEY)
    return ends.groupBy(*KEY, "rep").agg(
        (F.max(F.when(F.col("i") == F.col("stop_i") - 1, F.col("c")))
         - F.max(F.when(F.col("i") == F.col("start_i"), F.col("c")))).alias("gain"))


@query("g14_outer_extrema", "clip_id kind i", "t height", """
  WITH RECURSIVE near AS (SELECT *, lag(height) OVER w AS a, lead(height) OVER w AS b, min(height) OVER k AS lo, max(height) OVER k AS hi
      FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY i), k AS (PARTITION BY clip_id)),
    ext AS (SELECT *, row_number() OVER (PARTITION BY clip_id, kind ORDER BY i) AS r FROM (
      SELECT clip_id, i, t, height, CASE WHEN height <= a AND height <= b AND height < lo + (hi - lo)/3 THEN 'touch' END AS kind FROM near
      UNION ALL SELECT clip_id, i, t, height, CASE WHEN height >= a AND height >= b AND height > hi - (hi - lo)/3 THEN 'lockout' END FROM near)
      WHERE kind IS NOT NULL),
    walk AS (SELECT *, t AS last, true AS hit FROM ext WHERE r = 1
      UNION ALL SELECT c.*, CASE WHEN c.t - w.last > 0.8 THEN c.t ELSE w.last END, c.t - w.last > 0.8
      FROM walk w JOIN ext c ON c.clip_id = w.clip_id AND c.kind = w.kind AND c.r = w.r + 1)
  SELECT clip_id, kind, i, t, height FROM walk WHERE hit""", "track")
def _(spark, d):
    return events.outer_extrema(track(spark, d), ["clip_id"], "height")


# ---------------------------------------------------------------- J: joins ---


@query("j1_interval_join", "capture_id rep i", "value", """
  SELECT s.capture_id, r.rep, s.i, s.value FROM samples s JOIN reps r
    ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i""", "samples reps")
def _(spark, d):
    return interval_join(samples(spark, d).drop("n"), reps(spark, d).drop("n", BLOCK), KEY)


_TRK = "clock AS (SELECT clip_id AS capture_id, t, value AS v, event_id FROM (SELECT clip_id, t, coalesce(x, 0.5) AS value, event_id FROM track))"


def clock(spark, d):
    return track(spark, d).select(F.col("clip_id").alias("capture_id"), "t", F.coalesce("x", F.lit(0.5)).alias("v"))


_BRACKET = """SELECT s.capture_id, s.i, CASE WHEN p.t IS NULL THEN {lo} WHEN q.t IS NULL THEN {hi}
    WHEN p.t = q.t THEN p.v ELSE p.v + (q.v - p.v) * (s.t - p.t) / (q.t - p.t) END AS v
  FROM samples s ASOF LEFT JOIN clock p ON s.capture_id = p.capture_id AND s.t >= p.t
  ASOF LEFT JOIN clock q ON s.capture_id = q.capture_id AND s.t <= q.t"""


@query("j2_asof_interpolate", "capture_id i", "v", f"WITH {_TRK} " + _BRACKET.format(lo="q.v", hi="p.v"), "track", places=3)
def _(spark, d):
    return interpolate(samples(spark, d).select(*KEY, "i", "t"), clock(spark, d), KEY, "t", ["v"])


@query("j3_interpolate_zero_fill", "capture_id i", "v", f"WITH {_TRK} " + _BRACKET.format(lo="0", hi="0"), "track", places=3)
def _(spark, d):
    return interpolate(samples(spark, d).select(*KEY, "i", "t"), clock(spark, d), KEY, "t", ["v"], outside="fill")


_TWO = """lft AS (SELECT capture_id, t, row_number() OVER (PARTITION BY capture_id ORDER BY i) - 1 AS k FROM samples WHERE value > 80),
  rgt AS (SELECT capture_id, t, row_number() OVER (PARTITION BY capture_id ORDER BY i) - 1 AS k FROM samples WHERE value < 10),
  pairs AS (SELECT capture_id, k, lft.t AS left_t, rgt.t AS right_t FROM lft JOIN rgt USING (capture_id, k))"""


def pairs(spark, d):
    s = samples(spark, d)
    return sync.match_events(s.filter("value > 80"), s.filter("value < 10"), KEY)


@query("j4_match_by_position", "capture_id k", "left_t right_t", f"WITH {_TWO} SELECT * FROM pairs", "samples")
def _(spark, d):
    return pairs(spark, d)


@query("a4_affine_fit", "capture_id events refused", "slope shift rms_ms drift_pct", f"""
  WITH {_TWO}, fit AS (SELECT capture_id, count(*) AS events, regr_slope(left_t, right_t) AS slope, regr_intercept(left_t, right_t) AS shift
    FROM pairs GROUP BY 1)
  SELECT capture_id, events, events < 2 AS refused, max(slope) AS slope, max(shift) AS shift,
    sqrt(avg(pow(left_t - slope*right_t - shift, 2)))*1000 AS rms_ms, (max(slope)-1)*100 AS drift_pct
  FROM pairs JOIN fit USING (capture_id) GROUP BY ALL""", "samples", places=3)
def _(spark, d):
    return sync.affine_fit(pairs(spark, d), KEY).withColumnRenamed("offset", "shift")


@query("p7_clock_conversion", "clip_id i", "log_t", """
  SELECT clip_id, i, (t - (0.3 + clip_id % 3))/1.001 AS log_t FROM track""", "track")
def _(spark, d):
    t = track(spark, d)
    fit = t.groupBy("clip_id").agg(F.lit(1.001).alias("slope"), (F.lit(0.3) + F.col("clip_id") % 3).alias("offset"))
    return sync.to_log_time(t, fit, ["clip_id"], out="log_t")


_SPANS = f"spans AS (SELECT capture_id, i, t AS a, t + 0.7 AS b FROM picked)"


@query("j5_best_overlap", "capture_id i rep", "overlap", f"""
  WITH RECURSIVE {_PICK}, win AS (SELECT capture_id, i, lead(i) OVER (PARTITION BY capture_id ORDER BY i) AS ni FROM picked)
  SELECT capture_id, i, -arg_max(r, struct_pack(o := o, r := r)) AS rep, max(o)::DOUBLE AS overlap FROM (
    SELECT w.capture_id, w.i, -r.rep AS r, least(w.ni, r.stop_i - 1) - greatest(w.i, r.start_i) AS o
    FROM win w JOIN reps r ON r.capture_id = w.capture_id WHERE w.ni IS NOT NULL) WHERE o > 0 GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    from kinetrail.operators.whatif import best_overlap

    win = neighbours(picked(spark, d), KEY, {"ni": "i"}, step=1).filter("ni is not null").select(*KEY, "i", "ni")
    return best_overlap(win, reps(spark, d), KEY, ("i", "ni"))


@query("j6_intervals_with_event", "capture_id rep last_i", "", f"""
  WITH RECURSIVE {_PICK} SELECT r.capture_id, r.rep, max(p.i) AS last_i FROM reps r JOIN picked p
    ON p.capture_id = r.capture_id AND p.i >= r.start_i AND p.i < r.stop_i GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    return interval_join(picked(spark, d).drop("n"), reps(spark, d).drop("n", BLOCK), KEY).groupBy(*KEY, "rep").agg(
        F.max("i").alias("last_i"))


@query("j7_coverage", "capture_id rep covered", "", """
  SELECT capture_id, rep, coalesce(min(s.t) >= max(lo) AND max(s.t) <= max(hi), false) AS covered FROM reps r
  JOIN samples s USING (capture_id) LEFT JOIN (SELECT clip_id AS capture_id, min(t) AS lo, max(t) AS hi FROM track GROUP BY 1) k USING (capture_id)
  WHERE s.i >= start_i AND s.i < stop_i GROUP BY 1, 2""", "reps track")
def _(spark, d):
    ends = interval_join(samples(spark, d).drop("n"), reps(spark, d).drop("n", BLOCK), KEY).groupBy(*KEY, "rep").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"))
    return score.coverage(ends, clock(spark, d), KEY)


@query("j8_near_event_mask", "capture_id i near_impact", "", f"""
  WITH RECURSIVE {_PICK} SELECT s.capture_id, s.i, EXISTS (SELECT 1 FROM picked p WHERE p.capture_id = s.capture_id AND abs(s.t - p.t) <= 0.15)
    AS near_impact FROM samples s""", "samples")
def _(spark, d):
    return events.impact_mask(samples(spark, d), picked(spark, d), KEY, 0.15)


@query("j11_similar_in_group", "label vec_id hits best_id", "best", """
  WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE*y::DOUBLE)))) AS e
    FROM embeddings)
  SELECT a.label, a.vec_id, count(*) FILTER (WHERE list_dot_product(a.e, b.e) > 0.2) AS hits,
    arg_min(b.vec_id, struct_pack(d := -list_dot_product(a.e, b.e), v := b.vec_id)) AS best_id, max(list_dot_product(a.e, b.e)) AS best
  FROM u a LEFT JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2""")
def _(spark, d):
    return tile_products(unit_vectors(spark, d), ["label"], "vec_id", "e", 0.2)


def unit_vectors(spark, d):
    v = table(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    v = v.withColumn("_n", size).withColumn("e", F.transform("e", lambda x: x / F.col("_n")))
    return index_series(v.select("label", "vec_id", "e"), ["label"], ["vec_id"])


_LAGS = """grid AS (SELECT capture_id, i AS g, ax AS a, ay + ax / 3 AS b FROM samples)"""


@query("j12_lag_correlation", "capture_id lag points", "corr", f"""
  WITH {_LAGS} SELECT x.capture_id, l.lag, count(*) AS points, corr(x.a, y.b) AS corr FROM grid x, (SELECT unnest(range(-8, 9)) AS lag) l
  JOIN grid y ON y.capture_id = x.capture_id AND y.g = x.g + l.lag GROUP BY 1, 2""", "samples")
def _(spark, d):
    s = samples(spark, d).withColumns({"b": F.col("ay") + F.col("ax") / 3})
    return sync.lag_curve(s, s, KEY, "ax", "b", 8, grid="i")


@query("a10_best_lag", "capture_id lag", "corr", f"""
  WITH {_LAGS} SELECT capture_id, arg_max(lag, c) AS lag, max(c) AS corr FROM (
    SELECT x.capture_id, l.lag, corr(x.a, y.b) AS c FROM grid x, (SELECT unnest(range(-20, 21)) AS lag) l
    JOIN grid y ON y.capture_id = x.capture_id AND y.g = x.g + l.lag GROUP BY 1, 2 HAVING count(*) >= 30) GROUP BY 1""", "samples")
def _(spark, d):
    s = samples(spark, d).withColumns({"b": F.col("ay") + F.col("ax") / 3})
    c = sync.lag_curve(s, s, KEY, "ax", "b", 20, grid="i", need=30).filter("corr is not null")
    return c.groupBy(*KEY).agg(F.max_by("lag", "corr").alias("lag"), F.max("corr").alias("corr"))


# ----------------------------------------------------------- A: aggregates ---


@query("a1_key_statistics", "capture_id", "mid p95 mean lo hi std ptp", """
  SELECT capture_id, median(value) AS mid, quantile_cont(value, 0.95) AS p95, avg(value) AS mean, min(value) AS lo, max(value) AS hi,
    stddev_pop(value) AS std, max(value) - min(value) AS ptp FROM base GROUP BY 1""", "base", places=4)
def _(spark, d):
    s = samples(spark, d)
    q = exact_quantiles(s, KEY, {"mid": ("value", 0.5), "p95": ("value", 0.95)})
    return q.join(s.groupBy(*KEY).agg(
        F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("ptp")), KEY)


@query("a1_global_quantiles", "event_type", "q10 q50 q99", """
  SELECT event_type, quantile_cont(value, 0.1) AS q10, median(value) AS q50, quantile_cont(value, 0.99) AS q99 FROM base GROUP BY 1""",
       "base", places=3)
def _(spark, d):
    return exact_quantiles(indexed_events(spark, d), ["event_type"], {
        "q10": ("value", 0.1), "q50": ("value", 0.5), "q99": ("value", 0.99)}, accuracy=2000)


@query("a2_block_sem", "capture_id", "sem_ax", """
  SELECT capture_id, CASE WHEN count(*) < 2 THEN NULL ELSE stddev_samp(m)/sqrt(count(*)) END AS sem_ax FROM (
    SELECT capture_id, i // size AS b, avg(ax) AS m FROM (SELECT *, greatest(round_even(0.5*fs, 0)::BIGINT, 2) AS size FROM rated)
    WHERE i // size < n // size GROUP BY 1, 2) GROUP BY 1""", "rated")
def _(spark, d):
    from kinetrail.operators.calibrate import block_sem

    return block_sem(samples(spark, d).withColumn("len", F.col("n")), KEY, ["ax"], "i", 0.5)


@query("a3_principal_axis", "capture_id", "axis_x axis_y axis_ratio excursion", """
  WITH m AS (SELECT capture_id, var_samp(ax) AS a, var_samp(ay) AS c, covar_samp(ax, ay) AS b FROM samples GROUP BY 1),
  e AS (SELECT capture_id, cos(0.5*atan2(2*b, a-c)) AS axis_x, sin(0.5*atan2(2*b, a-c)) AS axis_y,
    ((a+c)/2 + sqrt(((a-c)/2)*((a-c)/2) + b*b)) / ((a+c)/2 - sqrt(((a-c)/2)*((a-c)/2) + b*b)) AS axis_ratio FROM m)
  SELECT capture_id, axis_x, axis_y, max(axis_ratio) AS axis_ratio, max(ax*axis_x + ay*axis_y) - min(ax*axis_x + ay*axis_y) AS excursion
  FROM samples JOIN e USING (capture_id) GROUP BY ALL""", "samples")
def _(spark, d):
    return score.principal_axis(samples(spark, d), KEY, "ax", "ay")


@query("a5_curve_difference", "capture_id", "rms worst", """
  SELECT capture_id, sqrt(avg(pow(ax - ay, 2))) AS rms, max(abs(ax - ay)) AS worst FROM samples GROUP BY 1""", "samples")
def _(spark, d):
    diff = F.col("ax") - F.col("ay")
    return samples(spark, d).groupBy(*KEY).agg(
        F.sqrt(F.avg(diff * diff)).alias("rms"), F.max(F.abs(diff)).alias("worst"))


@query("a8_interval_area", "capture_id rep", "area", """
  SELECT capture_id, rep, sum(CASE WHEN i > start_i THEN (value + pv)/2*(t - pt) ELSE 0 END) AS area FROM reps r JOIN (
    SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY i)) s USING (capture_id)
  WHERE s.i >= start_i AND s.i < stop_i GROUP BY 1, 2""", "samples reps")
def _(spark, d):
    return score.interval_area(samples(spark, d), reps(spark, d), KEY, "value", "area")


@query("a9_guarded_correlation", "capture_id", "corr", """
  SELECT capture_id, CASE WHEN count(*) >= 5 AND stddev_pop(ax) > 1e-9 AND stddev_pop(ay) > 1e-9 THEN corr(ax, ay) END AS corr
  FROM samples GROUP BY 1""", "samples")
def _(spark, d):
    return samples(spark, d).groupBy(*KEY).agg(score.guarded_corr("ax", "ay").alias("corr"))


@query("a12_ratio_of_medians", "capture_id", "ratio rep_ratio", """
  SELECT capture_id, median(a)/median(b) AS ratio, median(a/b) AS rep_ratio FROM (
    SELECT capture_id, rep, sqrt(avg(ax*ax)) AS a, sqrt(avg(ay*ay)) AS b FROM reps r JOIN samples s USING (capture_id)
    WHERE s.i >= start_i AND s.i < stop_i GROUP BY 1, 2) GROUP BY 1""", "samples reps")
def _(spark, d):
    per = interval_join(samples(spark, d).drop("n"), reps(spark, d).drop("n", BLOCK), KEY).groupBy(*KEY, "rep").agg(
        F.sqrt(F.avg(F.col("ax") * F.col("ax"))).alias("a"), F.sqrt(F.avg(F.col("ay") * F.col("ay"))).alias("b"))
    q = exact_quantiles(per, KEY, {"a": ("a", 0.5), "b": ("b", 0.5), "rep_ratio": (F.col("a") / F.col("b"), 0.5)})
    return q.withColumn("ratio", F.col("a") / F.col("b"))


@query("a14_decile_medians", "capture_id bin", "mid", """
  SELECT capture_id, least(floor(i::DOUBLE / n * 10), 9)::BIGINT AS bin, median(value) AS mid FROM base GROUP BY 1, 2""", "base")
def _(spark, d):
    s = samples(spark, d).withColumn("bin", F.least(F.floor(F.col("i") / F.col("n") * 10), F.lit(9)).cast("long"))
    return exact_quantiles(s, [*KEY, "bin"], {"mid": ("value", 0.5)})


@query("a15_distinct_counts", "event_type users rows_", "", """
  SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS rows_ FROM events GROUP BY 1""")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows_"))


@query("a16_mean_rotation", "capture_id", "mean_w mean_x mean_y mean_z")
def _(spark, d):
    from kinetrail.operators.calibrate import mean_rotation

    return mean_rotation(samples(spark, d), KEY)


# --------------------------------------------------------- G: segmentation ---


@query("g2_impact_cycles", "capture_id rep start_i stop_i", "", f"""
  WITH RECURSIVE {_PICK}, ev AS (SELECT *, row_number() OVER w - 1 AS rep, lag(i) OVER w AS prev_i, t - lag(t) OVER w AS gap FROM picked
    WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  opens AS (SELECT capture_id, max(t) FILTER (WHERE rep = 0) - coalesce(median(gap), 3.0) AS x FROM ev GROUP BY 1),
  start0 AS (SELECT capture_id, count(*) FILTER (WHERE t < x) AS s0 FROM samples JOIN opens USING (capture_id) GROUP BY 1)
  SELECT capture_id, rep, coalesce(prev_i + 1, s0) AS start_i, least(i + 1, n) AS stop_i FROM ev JOIN start0 USING (capture_id)
  WHERE least(i + 1, n) > coalesce(prev_i + 1, s0)""", "samples")
def _(spark, d):
    return segment.impact_cycles(samples(spark, d), picked(spark, d), KEY)


@query("g3_shape_vectors", "capture_id lobe g", "w", f"""
  WITH {_LOBES}, pts AS (SELECT capture_id, lobe, g, peak_t - 1.5 + g * 3.0 / 119 AS at FROM lobes, (SELECT unnest(range(0, 120)) AS g)),
  y AS (SELECT p.capture_id, p.lobe, p.g, CASE WHEN a.t IS NULL OR b.t IS NULL THEN 0 WHEN a.t = b.t THEN a.value - 40
    ELSE a.value - 40 + (b.value - a.value) * (p.at - a.t) / (b.t - a.t) END AS y FROM pts p
    ASOF LEFT JOIN samples a ON a.capture_id = p.capture_id AND p.at >= a.t ASOF LEFT JOIN samples b ON b.capture_id = p.capture_id AND p.at <= b.t)
  SELECT capture_id, lobe, g, (y - m) / s AS w FROM y JOIN (
    SELECT capture_id, lobe, avg(y) AS m, sqrt(sum(y*y) - count(*)*avg(y)*avg(y)) AS s FROM y GROUP BY 1, 2) USING (capture_id, lobe)""", "samples")
def _(spark, d):
    return shapes(spark, d).select(*KEY, "lobe", F.posexplode("shape").alias("g", "w")).withColumn("g", F.col("g").cast("long"))


def shapes(spark, d):
    s = samples(spark, d).withColumn("s", F.col("value") - 40)
    return segment.shape_vectors(s, lobe_rows(spark, d), KEY, "s")


_UP = f"{_LOBES}, up AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_i) - 1 AS k FROM lobes WHERE area > 0)"
_RUNS = """gp AS (SELECT *, peak_t - lag(peak_t) OVER w AS gap FROM src WINDOW w AS (PARTITION BY {key} ORDER BY k)),
  rt AS (SELECT *, greatest(gap / lag(gap) OVER w, lag(gap) OVER w / gap) AS ratio FROM gp WINDOW w AS (PARTITION BY {key} ORDER BY k)),
  isl AS (SELECT *, sum(CASE WHEN coalesce(ratio <= tol, false) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY k) AS run FROM rt WHERE gap IS NOT NULL),
  rn AS (SELECT {key}, run, min(k) - 1 AS first_k, max(k) AS last_k, count(*) + 1 AS size,
    coalesce(max(CASE WHEN ratio <= tol THEN ratio END), 1.0) AS drift FROM isl GROUP BY ALL),
  rm AS (SELECT rn.*, (SELECT median(peak_t) FROM src WHERE {same} AND k BETWEEN first_k AND last_k) AS mid_t FROM rn),
  best AS (SELECT {key}, arg_max(struct_pack(a := first_k, b := last_k), struct_pack(s := size, e := -drift, m := mid_t)) AS z FROM rm GROUP BY ALL),
  kept AS (SELECT src.* FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS total FROM src) src LEFT JOIN best USING ({key})
    WHERE total < 3 OR k BETWEEN z.a AND z.b)"""
_KEPT = _RUNS.format(key="capture_id", same="src.capture_id = rn.capture_id")


def up_lobes(spark, d):
    return lobe_rows(spark, d).filter("area > 0")


@query("g6_longest_cadence", "capture_id peak_i", "peak_t", f"""
  WITH {_UP}, src AS (SELECT *, 1.5 AS tol FROM up), {_KEPT} SELECT capture_id, peak_i, peak_t FROM kept""", "samples")
def _(spark, d):
    return segment.longest_cadence(up_lobes(spark, d), KEY)


@query("g13_cadence_sweep", "capture_id kept", "lowest highest", f"""
  WITH {_UP}, src AS (SELECT *, 1.1 + 0.3 * step AS tol FROM up, (SELECT unnest(range(0, 6)) AS step)),
  {_RUNS.format(key="capture_id, tol", same="src.capture_id = rn.capture_id AND src.tol = rn.tol")}
  SELECT capture_id, c AS kept, min(tol) AS lowest, max(tol) AS highest FROM (SELECT capture_id, tol, count(*) AS c FROM kept GROUP BY ALL) GROUP BY ALL""", "samples")
def _(spark, d):
    return segment.cadence_sweep(up_lobes(spark, d), KEY, [1.1 + 0.3 * z for z in range(6)])


@query("g8_merge_close", "capture_id peak_i", "peak_t area", f"""
  WITH RECURSIVE {_UP}, lim AS (SELECT capture_id, CASE WHEN count(*) > 2 THEN 0.6 * median(g) ELSE 0 END AS lim FROM (
      SELECT capture_id, peak_t - lag(peak_t) OVER (PARTITION BY capture_id ORDER BY k) AS g FROM up) GROUP BY 1),
  walk AS (SELECT up.capture_id, k, peak_i, peak_t, area, 0 AS slot FROM up WHERE k = 0
    UNION ALL SELECT u.capture_id, u.k, CASE WHEN u.peak_t - w.peak_t < lim AND u.area <= w.area THEN w.peak_i ELSE u.peak_i END,
      CASE WHEN u.peak_t - w.peak_t < lim AND u.area <= w.area THEN w.peak_t ELSE u.peak_t END,
      CASE WHEN u.peak_t - w.peak_t < lim AND u.area <= w.area THEN w.area ELSE u.area END,
      CASE WHEN u.peak_t - w.peak_t < lim THEN w.slot ELSE w.slot + 1 END
    FROM walk w JOIN up u ON u.capture_id = w.capture_id AND u.k = w.k + 1 JOIN lim ON lim.capture_id = u.capture_id)
  SELECT capture_id, arg_max(peak_i, k) AS peak_i, arg_max(peak_t, k) AS peak_t, arg_max(area, k) AS area FROM walk GROUP BY capture_id, slot""", "samples")
def _(spark, d):
    return segment.merge_close(up_lobes(spark, d), KEY)


_CHOSEN = """chosen AS (SELECT capture_id, lobe AS c, start_i AS cs, stop_i AS ce, peak_i AS cp, area AS ca,
    lag(peak_i) OVER (PARTITION BY capture_id ORDER BY lobe) AS before FROM lobes WHERE area > 0 AND lobe % 3 <> 1),
  walked AS (SELECT ch.*, l.lobe, l.start_i, coalesce((SELECT sum(-m.area) FROM lobes m WHERE m.capture_id = ch.capture_id AND m.area < 0
      AND m.lobe < ch.c AND m.lobe > l.lobe), 0) AS got
    FROM chosen ch JOIN lobes l ON l.capture_id = ch.capture_id AND l.lobe < ch.c AND (ch.before IS NULL OR l.peak_i > ch.before)),
  wide AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY cs) - 1 AS rep, coalesce(lo, cs) AS start_i, ce AS stop_i
    FROM chosen LEFT JOIN (SELECT capture_id, c, min(start_i) AS lo FROM walked WHERE got < 0.5*ca GROUP BY 1, 2) USING (capture_id, c))"""


def widened(spark, d):
    lobes = lobe_rows(spark, d)
    return segment.full_cycles(lobes, lobes.filter("area > 0 and lobe % 3 <> 1"), KEY)


@query("g9_full_cycles", "capture_id rep start_i stop_i", "", f"WITH {_LOBES}, {_CHOSEN} SELECT * FROM wide", "samples")
def _(spark, d):
    return widened(spark, d)


@query("g10_clip_overlaps", "capture_id rep start_i stop_i", "", f"""
  WITH {_LOBES}, {_CHOSEN} SELECT * FROM (SELECT capture_id, rep, greatest(start_i, coalesce(lag(stop_i) OVER (PARTITION BY capture_id ORDER BY rep), start_i)) AS start_i,
    stop_i FROM wide) WHERE stop_i > start_i""", "samples")
def _(spark, d):
    return segment.clip_overlaps(widened(spark, d), KEY)


@query("g4_similar_cluster", "capture_id lobe")
def _(spark, d):
    lobes = lobe_rows(spark, d)
    return segment.grow_clusters(lobes.join(shapes(spark, d), [*KEY, "lobe"]), KEY, similarity=0.3)


@query("g4_similarity_round0", "label vec_id members", "", """
  WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE*y::DOUBLE)))) AS e FROM embeddings)
  SELECT a.label, a.vec_id, count(*) FILTER (WHERE a.vec_id = b.vec_id OR list_dot_product(a.e, b.e) > 0.1) AS members
  FROM u a JOIN u b USING (label) GROUP BY 1, 2""")
def _(spark, d):
    got = tile_products(unit_vectors(spark, d), ["label"], "vec_id", "e", 0.1)
    return got.withColumn("members", F.col("hits") + 1)


@query("g5_rep_bounds", "capture_id rep start_i stop_i")
def _(spark, d):
    s = samples(spark, d).withColumn("vz", F.col("value") / 20 - 2.0)
    return segment.rep_bounds(s, KEY, "vz", impact_args={"threshold_g": 0.5, "gap_s": 0.5, "skip_s": 1.0},
                              band=(0.12, 1.0), similarity=0.3)


@query("g7_spread_cadence", "capture_id peak_i")
def _(spark, d):
    return segment.spread_cadence(up_lobes(spark, d), KEY, 3.0)
