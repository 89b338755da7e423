"""Detections and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import CLIP, detections, query, track
from kinetrail.operators import tracks as tk
from kinetrail.plans.blocks import BLOCK, index_series

_TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, f ORDER BY strength DESC, event_id) - 1 AS r FROM detections) WHERE r < {k})"""


@query("t1_strongest_per_frame", "clip_id f event_id r", "strength", f"WITH {_TOP.format(k=5)} SELECT * FROM top", "detections")
def _(spark, d):
    return tk.strongest(detections(spark, d), 5)


_STATIC = """samp AS (SELECT * FROM detections),
  cel AS (SELECT clip_id, round_even(y/40.0, 0)::BIGINT AS cy, round_even(x/40.0, 0)::BIGINT AS cx, count(DISTINCT f) AS seen, avg(y) AS y, avg(x) AS x FROM samp GROUP BY 1, 2, 3),
  fixed AS (SELECT cel.* FROM cel JOIN (SELECT clip_id, count(DISTINCT f) AS fr FROM samp GROUP BY 1) USING (clip_id) WHERE seen::DOUBLE / fr > 0.4)"""


def fixed(spark, d):
    return tk.static_points(detections(spark, d), cell=40.0, recur=0.4)


@query("a11_static_points", "clip_id cy cx", "y x", f"WITH {_STATIC} SELECT * FROM fixed", "detections")
def _(spark, d):
    return fixed(spark, d)


@query("j10_suppress_static", "clip_id f event_id", "", f"""
  WITH {_STATIC} SELECT clip_id, f, event_id FROM detections d WHERE NOT EXISTS (
    SELECT 1 FROM fixed s WHERE s.clip_id = d.clip_id AND sqrt(pow(s.y-d.y,2)+pow(s.x-d.x,2)) < 12.0)""", "detections")
def _(spark, d):
    return tk.suppress(detections(spark, d), fixed(spark, d), 12.0)


@query("k1_fixture_share", "clip_id dropped", "", f"""
  WITH {_STATIC} SELECT clip_id, count(*) FILTER (WHERE EXISTS (
    SELECT 1 FROM fixed s WHERE s.clip_id = d.clip_id AND sqrt(pow(s.y-d.y,2)+pow(s.x-d.x,2)) < 12.0)) AS dropped FROM detections d GROUP BY 1""", "detections")
def _(spark, d):
    det = detections(spark, d)
    kept = tk.suppress(det, fixed(spark, d), 12.0).groupBy("clip_id").agg(F.count(F.lit(1)).alias("_k"))
    return det.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_n")).join(kept, "clip_id", "left").select(
        "clip_id", (F.col("_n") - F.coalesce("_k", F.lit(0))).alias("dropped"))


@query("t5_merge_close_points", "clip_id f event_id", "", f"""
  WITH RECURSIVE {_TOP.format(k=1_000_000)}, walk AS (
    SELECT clip_id, f, 0::BIGINT AS r, [event_id] AS ids, [y] AS ys, [x] AS xs FROM top WHERE r = 0
    UNION ALL SELECT w.clip_id, w.f, t.r, CASE WHEN hit THEN ids ELSE list_append(ids, event_id) END, CASE WHEN hit THEN ys ELSE list_append(ys, y) END,
      CASE WHEN hit THEN xs ELSE list_append(xs, x) END FROM walk w, LATERAL (SELECT t.*, list_bool_or(list_transform(range(1, len(w.ys)+1),
        lambda q: sqrt(pow(list_extract(w.ys, q)-t.y,2)+pow(list_extract(w.xs, q)-t.x,2)) <= 60.0)) AS hit FROM top t WHERE t.clip_id = w.clip_id AND t.f = w.f AND t.r = w.r + 1) t)
  SELECT clip_id, f, unnest(ids) AS event_id FROM (SELECT clip_id, f, arg_max(ids, r) AS ids FROM walk GROUP BY 1, 2)""", "detections")
def _(spark, d):
    return tk.merge_close_points(detections(spark, d), 60.0)


@query("t3_spread_members", "clip_id f event_id", "", """
  WITH b AS (SELECT clip_id, f, arg_max(event_id, struct_pack(s := strength, e := -event_id)) AS event_id FROM detections GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM b)
  SELECT clip_id, f, event_id FROM r WHERE n <= 4 OR i IN (SELECT floor(j*n/4.0) FROM (SELECT unnest(range(0, 4)) AS j))""", "detections")
def _(spark, d):
    return tk.spread_members(detections(spark, d), ["clip_id"], 4, "strength")


_TRI = f"""{_TOP.format(k=1_000_000)}, tri AS (SELECT a.clip_id, a.f, a.r AS ra, b.r AS rb, c.r AS rc, (a.y+b.y+c.y)/3 AS cy, (a.x+b.x+c.x)/3 AS cx, (a.strength+b.strength+c.strength)/3 AS br,
    sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)) AS ab, sqrt(pow(a.y-c.y,2)+pow(a.x-c.x,2)) AS ac, sqrt(pow(b.y-c.y,2)+pow(b.x-c.x,2)) AS bc,
    a.y AS ay, a.x AS ax, b.y AS y2, b.x AS x2, c.y AS y3, c.x AS x3
    FROM top a JOIN top b ON a.clip_id = b.clip_id AND a.f = b.f AND a.r < b.r JOIN top c ON a.clip_id = c.clip_id AND a.f = c.f AND b.r < c.r),
  sc AS (SELECT *, greatest(0, 1 - (greatest(ab,ac,bc) - least(ab,ac,bc))/((ab+ac+bc)/3)/0.25) AS regularity,
    (sqrt(pow(ay-cy,2)+pow(ax-cx,2)) + sqrt(pow(y2-cy,2)+pow(x2-cx,2)) + sqrt(pow(y3-cy,2)+pow(x3-cx,2)))/3 AS circumradius FROM tri WHERE least(ab,ac,bc) > 0),
  hb AS (SELECT sc.*, (SELECT min(sqrt(pow(p.y-sc.cy,2)+pow(p.x-sc.cx,2))) FROM detections p WHERE p.clip_id = sc.clip_id AND p.f = sc.f) AS hub_distance
    FROM sc WHERE regularity > 0 AND circumradius BETWEEN 28 AND 150)"""


@query("k2_triple_hypotheses", "clip_id f ra rb rc", "circumradius regularity hub_distance score", f"""
  WITH {_TRI} SELECT * FROM (SELECT *, regularity*br AS score, row_number() OVER (PARTITION BY clip_id, f ORDER BY regularity*br DESC, ra, rb, rc) AS k
    FROM hb WHERE hub_distance < 0.8*circumradius) WHERE k <= 20""", "detections")
def _(spark, d):
    return tk.triples(detections(spark, d), top=20)


@query("k3_circles_through_triples", "clip_id f ra rb rc inliers", "radius", f"""
  WITH {_TOP.format(k=1_000_000)}, t AS (SELECT a.clip_id, a.f, a.r AS ra, b.r AS rb, c.r AS rc, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS y2, c.x AS cx, c.y AS cy,
    2*(a.x*(b.y-c.y)+b.x*(c.y-a.y)+c.x*(a.y-b.y)) AS d FROM top a JOIN top b ON a.clip_id = b.clip_id AND a.f = b.f AND a.r < b.r
    JOIN top c ON a.clip_id = c.clip_id AND a.f = c.f AND b.r < c.r),
  u AS (SELECT *, ((ax*ax+ay*ay)*(y2-cy)+(bx*bx+y2*y2)*(cy-ay)+(cx*cx+cy*cy)*(ay-y2))/d AS ux, ((ax*ax+ay*ay)*(cx-bx)+(bx*bx+y2*y2)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/d AS uy
    FROM t WHERE abs(d) >= 1e-9),
  r AS (SELECT clip_id, f, ra, rb, rc, uy AS cy, ux AS cx, sqrt(pow(ay-uy,2)+pow(ax-ux,2)) AS radius FROM u)
  SELECT r.clip_id, r.f, ra, rb, rc, r.cy, r.cx, radius, count(*) AS inliers FROM r JOIN top p ON p.clip_id = r.clip_id AND p.f = r.f
    AND abs(sqrt(pow(p.y-r.cy,2)+pow(p.x-r.cx,2)) - radius) <= 10 WHERE radius BETWEEN 28 AND 150 GROUP BY ALL HAVING count(*) >= 5""", "detections")
def _(spark, d):
    return tk.circles(detections(spark, d))


@query("k4_ellipse_fits", "clip_id f points", "centre_y centre_x semi_major semi_minor angle", places=2)
def _(spark, d):
    return tk.fit_ellipses(detections(spark, d), ["clip_id", "f"])


@query("k4_ellipse_hypotheses", "clip_id f inliers", "axis_ratio residual", places=2)
def _(spark, d):
    return tk.ellipse_hypotheses(detections(spark, d), tol_px=20.0)


@query("k5_size_groups", "clip_id size_group frames members", "merit", f"""
  WITH RECURSIVE {_TRI}, hy AS (SELECT clip_id, f, cy, cx, circumradius AS c, regularity*br AS score FROM hb WHERE hub_distance < 0.8*circumradius),
  walk AS (SELECT clip_id, max(c) AS head, 0::BIGINT AS g FROM hy GROUP BY 1
    UNION ALL SELECT w.clip_id, (SELECT max(c) FROM hy WHERE hy.clip_id = w.clip_id AND hy.c <= 0.85*w.head), w.g + 1 FROM walk w
    WHERE EXISTS (SELECT 1 FROM hy WHERE hy.clip_id = w.clip_id AND hy.c <= 0.85*w.head))
  SELECT hy.clip_id, w.g AS size_group, count(DISTINCT f) AS frames, count(*) AS members,
    avg(score)*count(DISTINCT f)*(1 + sqrt(pow(max(cy)-min(cy),2)+pow(max(cx)-min(cx),2))) AS merit
  FROM hy JOIN walk w ON w.clip_id = hy.clip_id AND hy.c <= w.head AND hy.c > 0.85*w.head GROUP BY 1, 2""", "detections", places=3)
def _(spark, d):
    return tk.score_groups(tk.size_groups(tk.triples(detections(spark, d))))


@query("k6_track_merit", "clip_id", "full_share coverage merit", """
  SELECT clip_id, avg(whole::INT) AS full_share, avg((x IS NOT NULL)::INT) AS coverage, coalesce(avg(whole::INT) * avg((x IS NOT NULL)::INT)
    / (1 + (quantile_cont(m_per_px_t, 0.95) - quantile_cont(m_per_px_t, 0.05))/0.05) / (1 + median(residual_px) FILTER (WHERE whole)), 0) AS merit
  FROM (SELECT *, n_markers >= 2 + clip_id % 2 AS whole FROM track) GROUP BY 1""", "track")
def _(spark, d):
    return tk.track_merit(track(spark, d), full=2 + F.col("clip_id") % 2)   # the markers of each clip's model


def pixels(spark, d):
    e = F.col("event_id")
    return track(spark, d).withColumns({
        "cy": ((e * 7919) % 160).cast("double"), "cx": ((e * 104729) % 160).cast("double"), "circumradius_px": F.lit(50.0) + e % 9})


_PIX = "pix AS (SELECT clip_id, i, ((event_id*7919) % 160)::DOUBLE AS cy, ((event_id*104729) % 160)::DOUBLE AS cx, 0.18/(50.0 + event_id % 9) AS s FROM track)"


@query("k7_metric_track", "clip_id i", "x height shift_cm", f"""
  WITH {_PIX} SELECT clip_id, i, (cx-80)*s - median((cx-80)*s) OVER w AS x, -(cy-80)*s - min(-(cy-80)*s) OVER w AS height,
    abs((-(cy-80)*s - min(-(cy-80)*s) OVER w) - (-cy*0.18/54 - min(-cy*0.18/54) OVER w))*100 AS shift_cm FROM pix WINDOW w AS (PARTITION BY clip_id)""", "track", places=6)
def _(spark, d):
    return tk.metric_track(pixels(spark, d))


@query("k7_template_metric_track", "clip_id i", "x height travel_m", f"""
  WITH {_PIX} SELECT clip_id, i, (cx - median(cx) OVER w)*0.002 AS x, -(cy - max(cy) OVER w)*0.002 AS height, (max(cy) OVER w - min(cy) OVER w)*0.002 AS travel_m
  FROM pix WINDOW w AS (PARTITION BY clip_id)""", "track")
def _(spark, d):
    return tk.template_metric_track(pixels(spark, d), 0.002)


_SWING = """swing AS (SELECT clip_id, degrees(max(u) - min(u)) AS rotation_deg FROM (SELECT clip_id, sum(s) OVER w AS u FROM (
    SELECT clip_id, i, coalesce(atan2(sin(angle - lag(angle) OVER w), cos(angle - lag(angle) OVER w)), angle) AS s FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY i))
    WINDOW w AS (PARTITION BY clip_id ORDER BY i)) GROUP BY 1)"""


def plates(spark, d):
    k = F.col("clip_id")
    return track(spark, d).select("clip_id").distinct().select(
        "clip_id", (k % 7).cast("double").alias("plate_y"), (k % 5).cast("double").alias("plate_x"), (F.lit(60.0) + k % 20).alias("plate_px"),
        F.lit(3.0).alias("rim_y"), F.lit(2.0).alias("rim_x"), F.lit(57.0).alias("circumradius_px"), F.lit(0.003).alias("m_per_px"))


_CAL = f"""{_SWING}, cal AS (SELECT clip_id, rotation_deg, sqrt(pow(3-clip_id%7,2)+pow(2-clip_id%5,2)) AS centre_offset_px, 57.0/(60+clip_id%20) AS sticker_ratio,
    abs(57.0/(60+clip_id%20) - 0.858) <= 0.15 AS credible, CASE WHEN abs(57.0/(60+clip_id%20) - 0.858) <= 0.15
      THEN sqrt(pow(3-clip_id%7,2)+pow(2-clip_id%5,2))*least(radians(rotation_deg), 2.0)*0.3 END AS spacing_bias_cm FROM swing)"""


@query("k8_calibration_report", "clip_id credible", "rotation_deg centre_offset_px sticker_ratio spacing_bias_cm", f"WITH {_CAL} SELECT * FROM cal", "track")
def _(spark, d):
    return tk.calibration_report(track(spark, d), plates(spark, d))


@query("k9_similarity_fit", "clip_id", "scale angle offset_y offset_x", """
  WITH p AS (SELECT clip_id, y AS sy, x AS sx, 0.9*y + 0.2*x + 3 + strength AS dy, 0.9*x - 0.2*y - 5 AS dx FROM detections),
  m AS (SELECT clip_id, avg(sy) AS my, avg(sx) AS mx, avg(dy) AS ny, avg(dx) AS nx, (covar_pop(sx,dx)+covar_pop(sy,dy))/(var_pop(sx)+var_pop(sy)) AS re,
    (covar_pop(sx,dy)-covar_pop(sy,dx))/(var_pop(sx)+var_pop(sy)) AS im FROM p GROUP BY 1)
  SELECT clip_id, sqrt(re*re+im*im) AS scale, atan2(im, re) AS angle, ny - (im*mx + re*my) AS offset_y, nx - (re*mx - im*my) AS offset_x FROM m""", "detections")
def _(spark, d):
    y, x = F.col("y"), F.col("x")
    p = detections(spark, d).select("clip_id", y.alias("sy"), x.alias("sx"), (0.9 * y + 0.2 * x + 3 + F.col("strength")).alias("dy"), (0.9 * x - 0.2 * y - 5).alias("dx"))
    return tk.similarity_fit(p, ["clip_id"])


@query("a13_top_of_travel", "clip_id", "top_score all_score top_px all_px", """
  SELECT clip_id, median(score) FILTER (WHERE near) AS top_score, median(score) AS all_score, median(residual_px) FILTER (WHERE near) AS top_px, median(residual_px) AS all_px
  FROM (SELECT *, height > max(height) OVER w - 0.15*(max(height) OVER w - min(height) OVER w) AS near FROM track WHERE height IS NOT NULL WINDOW w AS (PARTITION BY clip_id)) GROUP BY 1""", "track")
def _(spark, d):
    return tk.top_of_travel(track(spark, d), CLIP, {"score": F.col("score"), "px": F.col("residual_px")})


@query("v12_template_findings", "clip_id findings", "travel_m score top_score", """
  WITH n AS (SELECT *, height > max(height) OVER w - 0.15*(max(height) OVER w - min(height) OVER w) AS near FROM track WINDOW w AS (PARTITION BY clip_id)),
  a AS (SELECT clip_id, max(height) - min(height) AS travel_m, median(score) AS score, median(score) FILTER (WHERE near) AS top_score FROM n GROUP BY 1)
  SELECT *, CASE WHEN travel_m < 0.5 THEN 'refused' ELSE array_to_string(list_filter([CASE WHEN round(score, 9) < 0.45 THEN 'low_score' END,
    CASE WHEN round(top_score, 9) < 0.45 THEN 'low_top_score' END, CASE WHEN clip_id % 3 < 2 AND travel_m > 0.8 THEN 'travel_above'
      WHEN clip_id % 3 < 2 AND travel_m < 0.7 THEN 'travel_below' END], lambda z: z IS NOT NULL), ',') END AS findings FROM a""", "track")
def _(spark, d):
    t = track(spark, d)
    bands = t.select("clip_id").distinct().filter("clip_id % 3 < 2").select("clip_id", F.lit(0.7).alias("rom_lo"), F.lit(0.8).alias("rom_hi"))
    return tk.template_findings(t, CLIP, 0.5, 0.45, bands).withColumn("findings", F.array_join("findings", ","))


@query("v13_marker_findings", "clip_id findings", "coverage two_marker_share top_cm top_ratio", f"""
  WITH {_CAL}, n AS (SELECT *, height > max(height) OVER w - 0.15*(max(height) OVER w - min(height) OVER w) AS near, residual_px*m_per_px_t*100 AS cm FROM track WINDOW w AS (PARTITION BY clip_id)),
  a AS (SELECT clip_id, max(height) - min(height) AS travel_m, avg((height IS NOT NULL)::INT) AS coverage, avg(CASE WHEN height IS NOT NULL THEN (n_markers = 2)::INT END) AS two_marker_share,
    median(cm) FILTER (WHERE near) AS top_cm, median(residual_px) FILTER (WHERE near) AS tp, median(residual_px) AS ap FROM n GROUP BY 1)
  SELECT clip_id, coverage, two_marker_share, top_cm, CASE WHEN ap > 0 THEN tp/ap END AS top_ratio, array_to_string(list_filter([CASE WHEN travel_m IS NULL THEN 'never_tracked' END,
    CASE WHEN travel_m < 0.1 THEN 'static' END, CASE WHEN coverage < 0.9 THEN 'coverage' END, CASE WHEN two_marker_share > 0.25 THEN 'two_markers' END,
    CASE WHEN round(top_cm, 9) > 0.05 THEN 'top_residual' WHEN ap > 0 AND round(tp/ap, 9) > 4 THEN 'top_residual_ratio' END, CASE WHEN round(abs(sticker_ratio - 0.858), 9) > 0.15 THEN 'sticker_ratio' END,
    CASE WHEN round(spacing_bias_cm, 9) > 1 THEN 'spacing_bias' END], lambda z: z IS NOT NULL), ',') AS findings FROM a JOIN cal USING (clip_id)""", "track")
def _(spark, d):
    cal = tk.calibration_report(track(spark, d), plates(spark, d))
    return tk.marker_findings(track(spark, d), CLIP, cal, max_top_cm=0.05).withColumn("findings", F.array_join("findings", ","))


@query("v14_track_review", "clip_id n_reps reps_match implausible", "coverage travel_cm fore_aft_cm residual_px score", """
  WITH b AS (SELECT clip_id, avg((height IS NOT NULL AND x IS NOT NULL)::INT) AS coverage, (max(height)-min(height))*100 AS travel_cm, (max(x)-min(x))*100 AS fore_aft_cm,
    median(residual_px) AS residual_px, median(score) AS score, count(*) FILTER (WHERE i % 10 = 0) AS n_reps FROM track GROUP BY 1)
  SELECT *, clip_id % 3 = 0 OR 3 + clip_id % 2 = n_reps AS reps_match, coalesce(travel_cm < CASE WHEN clip_id % 4 < 3 THEN 80.0 END, false) AS implausible FROM b""", "track")
def _(spark, d):
    t, k = track(spark, d), F.col("clip_id")
    clips = t.select("clip_id").distinct().select(
        "clip_id", F.when(k % 3 != 0, F.lit(3) + k % 2).alias("expected_reps"), F.when(k % 4 < 3, F.lit(80.0 / 90)).alias("rom_lo"))
    return tk.review(t, t.filter("i % 10 = 0").select("clip_id"), clips, CLIP)
