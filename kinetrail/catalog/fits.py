"""Objectives, searches and transfer on rebuilt paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, query, samples, track
from kinetrail.catalog.repeats import _M5, bounds, scored
from kinetrail.catalog.signals import _g0, _sql_rotate
from kinetrail.operators import fit, studies, whatif
from kinetrail.operators.motion import ACCEL, QUAT
from kinetrail.plans.blocks import settle

BIAS, LEVER = (-0.02, 0.0, 0.02), (0.0, 0.09)
TERMS = {"bias": ("bias_x", 0.0, 0.0), "lever": ("lever_x", 0.0, 0.0)}

_w = _sql_rotate(("qw", "qx", "qy", "qz"), ("hx", "hy", "hz"))
_arm = _sql_rotate(("qw", "qx", "qy", "qz"), ("lever_x", "0", "0"))
_RUN = "(PARTITION BY capture_id, param_id ORDER BY i)"
#: rebuilt paths on a grid and their objective; column-wise restatement for the oracle
_OBJECTIVE = f"""grid AS (SELECT row_number() OVER (ORDER BY b, l) - 1 AS param_id, b AS bias_x, l AS lever_x
    FROM (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BIAS)}]) AS b) u, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVER)}]) AS l) v),
  pert AS (SELECT s.*, param_id, lever_x, ax + bias_x - {_g0[0]} AS hx, ay - {_g0[1]} AS hy, az - {_g0[2]} AS hz FROM samples s, grid),
  world AS (SELECT *, {_w[0]} AS wx, {_w[1]} AS wy FROM pert),
  vel AS (SELECT *, sum(dvx) OVER w AS vx, sum(dvy) OVER w AS vy FROM (
    SELECT *, CASE WHEN i = 0 THEN 0 ELSE (wx + lag(wx) OVER w) / 2 * dt END AS dvx, CASE WHEN i = 0 THEN 0 ELSE (wy + lag(wy) OVER w) / 2 * dt END AS dvy
    FROM world WINDOW w AS {_RUN}) WINDOW w AS {_RUN}),
  pos AS (SELECT *, sum(dx) OVER w - {_arm[0]} AS x0, sum(dy) OVER w - {_arm[1]} AS y0 FROM (
    SELECT *, CASE WHEN i = 0 THEN 0 ELSE (vx + lag(vx) OVER w) / 2 * dt END AS dx, CASE WHEN i = 0 THEN 0 ELSE (vy + lag(vy) OVER w) / 2 * dt END AS dy
    FROM vel WINDOW w AS {_RUN}) WINDOW w AS {_RUN}),
  trk AS (SELECT clip_id AS capture_id, t, x AS tx FROM track WHERE x IS NOT NULL),
  referee AS (SELECT s.capture_id, s.i, CASE WHEN p.t = q.t THEN p.tx ELSE p.tx + (q.tx - p.tx) * (s.t - p.t) / (q.t - p.t) END AS rx
    FROM samples s ASOF LEFT JOIN trk p ON p.capture_id = s.capture_id AND s.t >= p.t ASOF LEFT JOIN trk q ON q.capture_id = s.capture_id AND s.t <= q.t),
  inrep AS (SELECT p.capture_id, param_id, r.rep, p.i, first_value(t) OVER w AS t0, t - first_value(t) OVER w AS tau, last_value(t) OVER w - first_value(t) OVER w AS dur,
      x0, y0, first_value(x0) OVER w AS fx, last_value(x0) OVER w AS lx, first_value(y0) OVER w AS fy, last_value(y0) OVER w AS ly, rx, first_value(rx) OVER w AS frx
    FROM pos p JOIN reps r ON r.capture_id = p.capture_id AND p.i >= r.start_i AND p.i < r.stop_i JOIN referee f ON f.capture_id = p.capture_id AND f.i = p.i
    WINDOW w AS (PARTITION BY p.capture_id, param_id, r.rep ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  det AS (SELECT *, CASE WHEN dur > 0 THEN x0 - tau / dur * (lx - fx) ELSE x0 END - fx AS x, CASE WHEN dur > 0 THEN y0 - tau / dur * (ly - fy) ELSE y0 END - fy AS y, rx - frx AS r FROM inrep),
  seen AS (SELECT capture_id, param_id, rep, count(rx) = count(*) AS covered FROM det GROUP BY ALL),
  axis AS (SELECT capture_id, param_id, 0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS a FROM det GROUP BY ALL),
  live AS (SELECT d.*, x * cos(a) + y * sin(a) AS p FROM det d JOIN seen USING (capture_id, param_id, rep) JOIN axis USING (capture_id, param_id) WHERE covered),
  agree AS (SELECT capture_id, param_id, CASE WHEN sum(g) < 0 THEN -1 ELSE 1 END AS sign, count(*) AS n_compared FROM (
    SELECT capture_id, param_id, rep, covar_pop(p, r) * count(*) AS g FROM live GROUP BY ALL) GROUP BY ALL),
  per AS (SELECT l.capture_id, param_id, rep, sqrt(avg(pow(sign * p - r, 2))) * 100 AS h, sqrt(avg(r * r)) * 100 AS n FROM live l JOIN agree USING (capture_id, param_id) GROUP BY ALL),
  scores AS (SELECT x.capture_id, x.param_id::INTEGER AS param_id, coalesce(any_value(n_compared), 0) AS n_compared, coalesce(median(h), 'inf'::DOUBLE) AS h_rms, median(n) AS null_h_rms
    FROM axis x LEFT JOIN agree USING (capture_id, param_id) LEFT JOIN per USING (capture_id, param_id) GROUP BY ALL)"""


def refereed(spark, d):
    """What a rebuild reads of the samples, with the referee of the same capture."""
    s = samples(spark, d).select(*KEY, "i", "n", "t", "dt", *QUAT, *ACCEL)
    return settle(fit.with_referee(s, track(spark, d).withColumnRenamed("clip_id", "capture_id"), KEY))


def grid_scores(spark, d):
    own = whatif.grid_candidates({"bias_x": BIAS, "lever_x": LEVER}, TERMS)
    paths = whatif.rebuild_each(refereed(spark, d), KEY, own, [fit.REFEREE], bias_frame=None)
    return settle(fit.score_moments(fit.each_moments(paths, bounds(spark, d), KEY, len(own)), [*KEY, "param_id"]))


@query("o2_objective_grid", "capture_id param_id n_compared", "h_rms null_h_rms", f"WITH {_OBJECTIVE} SELECT * FROM scores", "samples reps track", places=2)
def _(spark, d):
    return grid_scores(spark, d)


@query("o3_fitted_parameters", "capture_id param_id", "h_rms", f"""
  WITH {_OBJECTIVE} SELECT capture_id, arg_min(param_id, struct_pack(h := h_rms, p := param_id)) AS param_id, min(h_rms) AS h_rms FROM scores GROUP BY 1""",
       "samples reps track", places=2)
def _(spark, d):
    return whatif.best_params(grid_scores(spark, d), KEY)


@query("o4_fitted_transfer", "capture_id param_id", "transferred ceiling", f"""
  WITH {_OBJECTIVE}, f AS (SELECT *, CASE WHEN isinf(h_rms) THEN 0 ELSE h_rms END AS h, isinf(h_rms)::INTEGER AS bad FROM scores),
  o AS (SELECT *, sum(bad) OVER w - bad AS others_bad, sum(h) OVER w - h AS others FROM f WINDOW w AS (PARTITION BY param_id))
  SELECT capture_id, arg_min(param_id, struct_pack(b := others_bad, r := others, p := param_id)) AS param_id,
    arg_min(h_rms, struct_pack(b := others_bad, r := others, p := param_id)) AS transferred, min(h_rms) AS ceiling FROM o GROUP BY 1""", "samples reps track", places=2)
def _(spark, d):
    return whatif.transfer(grid_scores(spark, d), "capture_id")


#: the search's first round alone is the best of a grid of three biases around 0
@query("o3_bracket_search", "capture_id n_compared", "bias_x start_h_rms h_rms null_h_rms beats_null")
def _(spark, d):
    return fit.bracket_search(refereed(spark, d), bounds(spark, d), KEY, {"bias_x": (0.0, 0.02)},
                              {"bias": ("bias_x", 0.0, 0.0)}, rounds=3, bias_frame=None)


_CEILING = f"""{_M5}, e AS (SELECT capture_id, rep, tau / dur AS u, unnest([
      struct_pack(axis := 'horizontal', e := wu - ru, p := pu - ru, r := ru), struct_pack(axis := 'vertical', e := wh - rhh, p := ph - rhh, r := rhh)]) AS a
    FROM (SELECT cs.*, d.tau, d.dur FROM cs JOIN det d USING (capture_id, rep, i))),
  fl AS (SELECT capture_id, rep, u, a.axis AS axis, a.e AS e, a.p AS p, a.r AS r FROM e),
  co AS (SELECT capture_id, rep, axis, regr_slope(e, u) AS s, regr_intercept(e, u) AS c, regr_slope(u*u, u) AS qs, regr_intercept(u*u, u) AS qc FROM fl GROUP BY ALL),
  rs AS (SELECT fl.*, e - s*u - c AS er, u*u - qs*u - qc AS q FROM fl JOIN co USING (capture_id, rep, axis)),
  ceil_rep AS (SELECT capture_id, rep, axis, sqrt(avg(p*p))*100 AS shipped, sqrt(avg(r*r))*100 AS "null", stddev_pop(e)*100 AS order_0, sqrt(avg(er*er))*100 AS order_1,
    sqrt(greatest(avg(er*er) - pow(sum(er*q), 2)/sum(q*q)/count(*), 0))*100 AS order_2 FROM rs GROUP BY ALL)"""


@query("o9_ceiling_per_rep", "capture_id rep axis", "shipped order_0 order_1 order_2", f"WITH {_CEILING} SELECT * FROM ceil_rep", "samples reps track", places=2)
def _(spark, d):
    return fit.ceiling(scored(spark, d)[2], KEY)


@query("o9_ceiling_table", "capture_id axis", "shipped order_1 order_2 headroom gain", f"""
  WITH {_CEILING} SELECT capture_id, axis, median(shipped) AS shipped, median(order_1) AS order_1, median(order_2) AS order_2,
    median(shipped) - median(order_1) AS headroom, median(order_1) - median(order_2) AS gain FROM ceil_rep GROUP BY ALL""", "samples reps track", places=2)
def _(spark, d):
    return fit.ceiling_table(settle(fit.ceiling(scored(spark, d)[2], KEY)), KEY)


_P = """list_sum(list_transform(range(hits, reps + 1), lambda j: 1.0 / factorial(j::INTEGER) * list_sum(list_transform(range(0, reps - j + 1),
    lambda i: (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END) / factorial(i::INTEGER)))))"""


@query("m14_identification_p", "capture_id form reps hits", "p", f"""
  WITH {_M5}, c AS (SELECT 'plain' AS form, capture_id, rep, j, pu AS a, ru AS b FROM cs
    UNION ALL SELECT 'demeaned', capture_id, rep, j, pu - avg(pu) OVER w, ru - avg(ru) OVER w FROM cs WINDOW w AS (PARTITION BY capture_id, j)),
  v AS (SELECT form, capture_id, rep, list(a ORDER BY j) AS a, list(b ORDER BY j) AS b FROM c GROUP BY ALL),
  dd AS (SELECT p.form, p.capture_id, p.rep, q.rep AS other, list_distance(p.a, q.b) AS d FROM v p JOIN v q USING (form, capture_id)),
  h AS (SELECT form, capture_id, count(*) AS reps, count(*) FILTER (near = rep) AS hits FROM (
    SELECT form, capture_id, rep, arg_min(other, struct_pack(d := round(d, 9), o := other)) AS near FROM dd GROUP BY ALL) GROUP BY ALL)
  SELECT *, {_P} AS p FROM h""", "samples reps track", places=6)
def _(spark, d):
    """Rebuilt reps against the referee's, as they are and with each capture's mean rep taken from both."""
    curves = settle(scored(spark, d)[2].select(*KEY, "rep", "j", "pipe_u", "ref_u"))
    both = curves.withColumn("form", F.lit("plain")).unionByName(
        studies.demeaned(curves, KEY, "j", ["pipe_u", "ref_u"]).withColumn("form", F.lit("demeaned")))
    each = [*KEY, "form"]

    def curve(c):
        return both.groupBy(*each, "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", c))), lambda e: e[c]).alias("v"))
    return studies.identification_table(studies.rep_identification(curve("pipe_u"), curve("ref_u"), each, "v"), each)
