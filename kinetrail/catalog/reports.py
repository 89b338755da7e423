"""Report tables that combine several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.catalog.base import KEY, query, samples
from kinetrail.catalog.events import _PICK, picked
from kinetrail.catalog.repeats import _DET, _IMP, _M5, AXES, bounds, lifted, marks, paths, scored
from kinetrail.catalog.signals import _HOLDS, _RANKED
from kinetrail.operators import calibrate, motion, reports, score
from kinetrail.operators.studies import rep_residual
from kinetrail.plans.blocks import neighbours, settle
from kinetrail.plans.joins import interval_join


@query("q6_closure_groups", "kind part intervals shown_capture_id shown_start_i", "mean_dv rms_dv median_dv median_s", f"""
  WITH RECURSIVE {_PICK}, {_IMP}, iv AS (SELECT capture_id, i AS start_i, t, lead(i) OVER w AS stop_i, lead(t) OVER w AS t2 FROM picked WINDOW w AS (PARTITION BY capture_id ORDER BY i)),
  m8 AS (SELECT iv.capture_id, start_i, t2 - t AS duration_s, EXISTS (SELECT 1 FROM imp WHERE imp.capture_id = iv.capture_id AND imp.i >= start_i AND imp.i < stop_i) AS hit,
    (SELECT coalesce(sum((s.az + p.az)/2*(s.t - p.t)), 0) FROM samples s JOIN samples p ON p.capture_id = s.capture_id AND p.i = s.i - 1
     WHERE s.capture_id = iv.capture_id AND s.i > start_i AND s.i < stop_i) AS dv FROM iv WHERE stop_i IS NOT NULL),
  k AS (SELECT *, CASE capture_id % 4 WHEN 0 THEN 'bench' ELSE 'deadlift' END AS kind,
    CASE WHEN capture_id % 4 = 0 THEN 'lifting' WHEN hit THEN 'impact inside' ELSE 'pull only' END AS part FROM m8 WHERE capture_id % 4 IN (0, 2)),
  md AS (SELECT kind, part, median(dv) AS median_dv, median(duration_s) AS median_s FROM k GROUP BY 1, 2),
  sh AS (SELECT k.kind, k.part, arg_min(struct_pack(c := capture_id, s := start_i), struct_pack(f := round(abs(dv - median_dv), 6), c := capture_id, s := start_i)) AS x
    FROM k JOIN md ON k.kind = md.kind AND k.part = md.part GROUP BY 1, 2),
  g AS (SELECT kind, part, count(*) AS intervals, avg(dv) AS mean_dv, sqrt(avg(dv*dv)) AS rms_dv FROM k GROUP BY GROUPING SETS ((kind, part), (kind), ()))
  SELECT g.*, median_dv, median_s, sh.x.c AS shown_capture_id, sh.x.s AS shown_start_i FROM g LEFT JOIN md ON g.kind = md.kind AND g.part = md.part
  LEFT JOIN sh ON g.kind = sh.kind AND g.part = sh.part""", "samples")
def _(spark, d):
    spans = lifted(score.closure_between(samples(spark, d), settle(picked(spark, d)), marks(spark, d), KEY, "az"))
    kind = F.when(F.col("lift").isin("bench", "deadlift"), F.col("lift"))
    return reports.closure_groups(spans, kind, ("deadlift",), ("capture_id", "start_i"))


_SUM = "sum({0}) OVER (PARTITION BY capture_id ORDER BY i)"
_HALF = "CASE WHEN i = 0 THEN 0 ELSE ({0} + lag({0}) OVER (PARTITION BY capture_id ORDER BY i))/2*dt END"


@query("q7_bias_variants", "capture_id reps_", "none rep_mean closure rest_mean", f"""
  WITH RECURSIVE {_PICK}, v0 AS (SELECT *, {_HALF.format('ax')} AS sx, {_HALF.format('ay')} AS sy FROM samples),
  v1 AS (SELECT *, {_SUM.format('sx')} AS vx, {_SUM.format('sy')} AS vy FROM v0), p0 AS (SELECT *, {_HALF.format('vx')} AS ux, {_HALF.format('vy')} AS uy FROM v1),
  it AS (SELECT *, {_SUM.format('ux')} AS px, {_SUM.format('uy')} AS py FROM p0),
  mean AS (SELECT r.capture_id, r.rep, avg(ax) AS mx, avg(ay) AS my FROM reps r JOIN samples s ON s.capture_id = r.capture_id AND s.i >= start_i AND s.i < stop_i GROUP BY 1, 2),
  seg AS (SELECT capture_id, i AS a, lead(i) OVER (PARTITION BY capture_id ORDER BY i) AS b FROM picked),
  bias AS (SELECT capture_id, avg(ax) AS rx, avg(ay) AS ry FROM (SELECT seg.capture_id, a, avg(ax) AS ax, avg(ay) AS ay FROM seg JOIN samples s
    ON s.capture_id = seg.capture_id AND s.i >= a AND s.i < b GROUP BY 1, 2) GROUP BY 1),
  e AS (SELECT m.*, b.t - a.t AS T, b.px - a.px - a.vx*(b.t - a.t) AS dx, b.py - a.py - a.vy*(b.t - a.t) AS dy, b.vx - a.vx AS ex, b.vy - a.vy AS ey,
    coalesce(rx, 0) AS rx, coalesce(ry, 0) AS ry FROM mean m JOIN reps r ON r.capture_id = m.capture_id AND r.rep = m.rep
    JOIN it a ON a.capture_id = r.capture_id AND a.i = r.start_i JOIN it b ON b.capture_id = r.capture_id AND b.i = r.stop_i - 1
    LEFT JOIN bias ON bias.capture_id = m.capture_id)
  SELECT capture_id, count(*) AS reps_, median(sqrt(dx*dx + dy*dy)) AS "none", median(sqrt(pow(dx - mx*T*T/2, 2) + pow(dy - my*T*T/2, 2))) AS rep_mean,
    median(sqrt(pow(dx - ex*T/2, 2) + pow(dy - ey*T/2, 2))) AS closure, median(sqrt(pow(dx - rx*T*T/2, 2) + pow(dy - ry*T*T/2, 2))) AS rest_mean
  FROM e GROUP BY 1""", "samples reps", places=3)
def _(spark, d):
    s = samples(spark, d)
    x = motion.double_integral(s, KEY, ("ax", "ay"), ("vx", "vy"), ("px", "py"))
    rests = neighbours(picked(spark, d), KEY, {"stop_i": "i"}, step=1).filter("stop_i is not null").withColumnRenamed("i", "start_i")
    return reports.bias_variants(x, bounds(spark, d), rests, KEY, ("ax", "ay"), ("vx", "vy"), ("px", "py"))


@query("q8_two_anchors", "capture_id", "open_deg close_deg change_deg span_s rep_residual", f"""
  WITH {_RANKED}, {_HOLDS}, per AS (SELECT capture_id, hold, degrees(asin(least(sqrt(avg(ax)*avg(ax)+avg(ay)*avg(ay))/9.80665, 1))) AS deg,
    max(CASE WHEN k - start_k = len // 2 THEN t END) AS mt FROM held GROUP BY 1, 2),
  b4 AS (SELECT o.capture_id, o.deg AS open_deg, c.deg AS close_deg, c.deg - o.deg AS change_deg, c.mt - o.mt AS span_s
    FROM per o JOIN per c ON o.capture_id = c.capture_id AND o.hold = 'open' AND c.hold = 'close'),
  b8 AS (SELECT capture_id, median(r) AS rep_residual FROM (SELECT r.capture_id, r.rep, sqrt(avg(ax)*avg(ax) + avg(ay)*avg(ay))/9.80665 AS r FROM reps r
    JOIN samples s ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i GROUP BY 1, 2) GROUP BY 1)
  SELECT coalesce(b4.capture_id, b8.capture_id) AS capture_id, b4.* EXCLUDE (capture_id), rep_residual FROM b4 FULL JOIN b8 ON b4.capture_id = b8.capture_id""", "rated reps")
def _(spark, d):
    s = samples(spark, d)
    return reports.two_anchors(calibrate.hold_tilt(s, KEY, AXES), rep_residual(s, bounds(spark, d), KEY, AXES), KEY)


@query("q9_paired_ranges", "capture_id rep", "raw corrected track raw_off corrected_off", f"""
  WITH {_M5}, w AS (SELECT r.capture_id, r.rep, max(az) - min(az) AS raw FROM reps r JOIN samples s
    ON s.capture_id = r.capture_id AND s.i >= r.start_i AND s.i < r.stop_i GROUP BY 1, 2), c AS (SELECT capture_id, rep, max(z) - min(z) AS corrected FROM det GROUP BY 1, 2)
  SELECT w.capture_id, w.rep, raw, corrected, video_rom_cm/100 AS track, raw - video_rom_cm/100 AS raw_off, corrected - video_rom_cm/100 AS corrected_off
  FROM w LEFT JOIN c ON c.capture_id = w.capture_id AND c.rep = w.rep LEFT JOIN pr ON pr.capture_id = w.capture_id AND pr.rep = w.rep""", "samples reps track", places=3)
def _(spark, d):
    own = [*KEY, "rep"]
    rows = interval_join(samples(spark, d).select(*KEY, "i", "_blk", "az"), bounds(spark, d), KEY)
    return reports.paired_ranges({
        "raw": rows.groupBy(*own).agg((F.max("az") - F.min("az")).alias("rom")),
        "corrected": paths(spark, d).groupBy(*own).agg((F.max("z") - F.min("z")).alias("rom")),
        "track": scored(spark, d)[0].select(*own, (F.col("video_rom_cm") / 100).alias("rom")),
    }, own, "track")
