"""Smaller measurements used by the reports: residuals, closures, closeness."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.operators.motion import QUAT, WORLD
from kinetrail.operators.score import at_or_after, interval_area
from kinetrail.operators.windows import quietest_slide
from kinetrail.plans.blocks import BLOCK, lookup, neighbours, per_key, settle, windowed
from kinetrail.plans.joins import bracket, interval_join, salted_join, time_range_join
from kinetrail.plans.quantiles import exact_medians


def rep_residual(series: DataFrame, reps: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD) -> DataFrame:
    """Mean horizontal acceleration of each rep in g: zero for a perfect rep."""
    mean = interval_join(series.select(*keys, "i", BLOCK, *world), reps.select(*keys, "rep", "start_i", "stop_i"), keys)
    x, y = F.avg(world[0]), F.avg(world[1])
    return mean.groupBy(*keys, "rep").agg((F.sqrt(x * x + y * y) / geo.G).alias("residual"))


def exclusion_sweep(series: DataFrame, reps: DataFrame, impact_rows: DataFrame, keys: Sequence[str],
                    pads: Sequence[int], world: Sequence[str] = WORLD, least: int = 10) -> DataFrame:
    """Median rep residual with rows within ``pad`` rows of an impact left out."""
    keys = list(keys)
    widest = max(pads)
    near = impact_rows.select(*keys, F.col("i").alias("_k"), (F.col("i") - widest).alias("start_i"),
                              (F.col("i") + widest + 1).alias("stop_i"))
    close = interval_join(series.select(*keys, "i", BLOCK), near, keys).groupBy(*keys, "i").agg(
        F.min(F.abs(F.col("i") - F.col("_k"))).alias("_off"))
    rows = interval_join(series.select(*keys, "i", BLOCK, *world), reps.select(*keys, "rep", "start_i", "stop_i"), keys)
    rows = rows.join(close, [*keys, "i"], "left").withColumn("pad", F.explode(F.array(*[F.lit(p) for p in pads])))
    kept = rows.filter(F.col("_off").isNull() | (F.col("_off") > F.col("pad")))
    x, y = F.avg(world[0]), F.avg(world[1])
    per = kept.groupBy(*keys, "rep", "pad").agg(
        F.sqrt(x * x + y * y).alias("_v"), F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > least)
    return exact_medians(per, [*keys, "pad"], {"_m": "_v"}).select(
        *keys, "pad", (F.col("_m") / geo.G).alias("residual"))


def zero_mean_reps(series: DataFrame, reps: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD) -> DataFrame:
    """Each rep's acceleration less its own mean."""
    spans = reps.select(*keys, "rep", "start_i", "stop_i")
    mean = interval_join(series.select(*keys, "i", BLOCK, *world), spans, keys).groupBy(
        *spans.columns).agg(*[F.avg(w).alias(f"_m_{w}") for w in world])
    return interval_join(series, mean, keys).withColumns({w: F.col(w) - F.col(f"_m_{w}") for w in world}).drop(
        *[f"_m_{w}" for w in world])


def closure_bias(series: DataFrame, rests: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD) -> DataFrame:
    """Mean over rest-to-rest intervals of the mean acceleration inside them."""
    pair = neighbours(rests, keys, {"stop_i": "i"}, step=1).filter("stop_i is not null")
    spans = pair.select(*keys, F.col("i").alias("start_i"), "stop_i")
    per = interval_join(series.select(*keys, "i", BLOCK, *world), spans, keys).groupBy(*keys, "start_i").agg(
        *[F.avg(w).alias(w) for w in world])
    return per.groupBy(*keys).agg(*[F.avg(w).alias(f"bias_{w}") for w in world])


def momentum_between(series: DataFrame, rests: DataFrame, keys: Sequence[str], accel: str = "wz") -> DataFrame:
    pair = neighbours(rests, keys, {"stop_i": "i"}, step=1).filter("stop_i is not null")
    return interval_area(series, pair.select(*keys, F.col("i").alias("start_i"), "stop_i"), keys, accel, "dv")


def tiled_line_residual(series: DataFrame, keys: Sequence[str], values: Sequence[str], start_s: float = 5.0,
                        tile_s: float = 2.0) -> DataFrame:
    """Median over tiles of the largest departure from each tile's own line.

    A rank proxy on fixed tiles, for comparing two treatments of one recording.
    """
    ends = per_key(series, keys, F.max("t").alias("_end"))
    x = lookup(series.select(*keys, "i", "n", BLOCK, "t", *values), keys, ends)
    tile = F.floor((F.col("t") - start_s) / tile_s)
    x = x.withColumn("tile", tile).filter(
        (F.col("tile") >= 0) & (F.lit(start_s) + F.col("tile") * tile_s < F.col("_end") - tile_s))
    fits = x.groupBy(*keys, "tile").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.regr_slope(v, "t").alias(f"_s_{v}") for v in values],
        *[F.regr_intercept(v, "t").alias(f"_c_{v}") for v in values])
    # one fit row per tile; the tile's rows are spread by salt
    y = salted_join(x, fits, [*keys, "tile"], F.col("i"))
    off = [F.abs(F.col(v) - F.coalesce(F.col(f"_s_{v}") * F.col("t") + F.col(f"_c_{v}"), F.col(v))) for v in values]
    far = F.greatest(*off) if len(off) > 1 else off[0]
    per = y.groupBy(*keys, "tile").agg(F.max(far).alias("_far"))
    return exact_medians(per, keys, {"residual": "_far"})


def range_in_window(series: DataFrame, instants: DataFrame, keys: Sequence[str], value: str, half_s: float,
                    out: str) -> DataFrame:
    """max - min of ``value`` within ``half_s`` of each instant (column ``at``)."""
    win = instants.select(*keys, "at", (F.col("at") - half_s).alias("_lo"), (F.col("at") + half_s).alias("_hi"))
    near = time_range_join(series.select(*keys, "i", "t", value), win, keys, "t", "_lo", "_hi", 2 * half_s, "neither")
    return near.groupBy(*keys, "at").agg((F.max(value) - F.min(value)).alias(out))


def step_around(series: DataFrame, instants: DataFrame, keys: Sequence[str], value: str, before_s: float,
                after_s: float, reach: float) -> DataFrame:
    """``value`` at the first sample at or after ``at + after_s`` less the one
    at or after ``at - before_s``."""
    lo = at_or_after(series, instants.select(*keys, "at", (F.col("at") - before_s).alias("_q")), keys, "_q", [value], reach)
    hi = at_or_after(series, instants.select(*keys, "at", (F.col("at") + after_s).alias("_q")), keys, "_q", [value], reach)
    a = lo.select(*keys, "at", F.col(f"found_{value}").alias("_a"))
    b = hi.select(*keys, "at", F.col(f"found_{value}").alias("_b"))
    return a.join(b, [*keys, "at"]).select(*keys, "at", (F.col("_b") - F.col("_a")).alias("step"))


def phase_in_window(instants: DataFrame, windows: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Where each instant falls in the window holding it, and whether a window
    holds exactly one.  ``windows``: keys, rep, t0, t1."""
    hit = time_range_join(instants.select(*keys, "i", "t"), windows.select(*keys, "rep", "t0", "t1"), keys,
                          "t", "t0", "t1", width)
    got = hit.groupBy(*keys, "rep").agg(
        F.count(F.lit(1)).alias("inside"), F.min((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("phase"))
    return windows.select(*keys, "rep").join(got, [*keys, "rep"], "left").select(
        *keys, "rep", F.coalesce("inside", F.lit(0)).alias("inside"), "phase",
        (F.coalesce("inside", F.lit(0)) == 1).alias("exactly_one"))


def position_between(touches: DataFrame, lockouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the way from the previous lockout to the next, per touch."""
    got = bracket(touches.select(*keys, "t"), lockouts.select(*keys, "t"), keys, "t", [])
    a, b = F.col("_prev.t"), F.col("_next.t")
    return got.filter((a < F.col("t")) & (b > F.col("t"))).select(*keys, "t", ((F.col("t") - a) / (b - a)).alias("share"))


def peaks_between(track: DataFrame, landings: DataFrame, keys: Sequence[str], height: str = "height",
                  least: float = 0.2) -> DataFrame:
    """Highest point and its time between consecutive landings (recording ends
    count as landings), kept above ``least``."""
    n = track.groupBy(*keys).agg(F.max("n").alias("n"))
    marks = landings.select(*keys, "i").unionByName(n.select(*keys, F.lit(0).cast("long").alias("i"))).distinct()
    marks = marks.unionByName(n.select(*keys, F.col("n").alias("i")))
    from kinetrail.plans.blocks import ordinal, reblock

    pair = neighbours(reblock(marks), keys, {"stop_i": "i"}, step=1).filter("stop_i is not null")
    spans = ordinal(reblock(pair.select(*keys, "i", "stop_i")), keys, "gap_no").select(
        *keys, "gap_no", F.col("i").alias("start_i"), "stop_i")
    inside = interval_join(track.select(*keys, "i", BLOCK, "t", height), spans, keys)
    got = inside.groupBy(*keys, "gap_no").agg(
        F.max(height).alias("peak"), F.min_by("t", F.struct(-F.col(height), "i")).alias("peak_t"))
    return got.filter(F.col("peak") > least)


def band_health(track: DataFrame, keys: Sequence[str], good: float = 0.6, bottom_m: float = 0.10,
                top_m: float = 0.05) -> DataFrame:
    """Share of good scores near the bottom, fore-aft spread near the top."""
    x = track.filter("height is not null and score is not null")
    ends = per_key(x, keys, F.min("height").alias("_lo"), F.max("height").alias("_hi"))
    y = lookup(x, keys, ends)
    low, high = F.col("height") < F.col("_lo") + bottom_m, F.col("height") > F.col("_hi") - top_m
    return y.groupBy(*keys).agg(
        F.avg(F.when(low, (F.col("score") > good).cast("double"))).alias("good_low"),
        (F.max(F.when(high, F.col("x"))) - F.min(F.when(high, F.col("x")))).alias("spread_high"))


def attitude_drift(series: DataFrame, keys: Sequence[str], rate: Column, span_s: float = 8.0) -> DataFrame:
    """Angle between the first and last attitude of the quietest span."""
    at = quietest_slide(series, keys, rate, span_s)
    n = per_key(series, keys).join(at, list(keys))
    inside = lookup(series.select(*keys, "i", "n", BLOCK, "t", *QUAT), keys, n, "inner").filter(
        (F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("start_t") + span_s))
    q = F.struct(*QUAT)
    ends = inside.groupBy(*keys).agg(F.min_by(q, "i").alias("_a"), F.max_by(q, "i").alias("_b"))
    a = geo.unit(tuple(F.col(f"_a.{c}") for c in QUAT))
    b = geo.unit(tuple(F.col(f"_b.{c}") for c in QUAT))
    return ends.select(*keys, F.degrees(geo.rotation_angle(geo.multiply(b, geo.inverse(a)))).alias("drift_deg"))


def window_change_corr(series: DataFrame, keys: Sequence[str], accel: str, velocity: str, width: int = 30,
                       stride: int = 10) -> DataFrame:
    """Correlation of velocity changes over short windows: integrated
    acceleration against differences of the referee's velocity.

    ``series`` is on one common grid (columns t, accel, velocity).
    """
    from kinetrail.plans.blocks import prefix

    slab = windowed(series, keys, lambda w: {"_s": F.coalesce(
        (F.col(accel) + F.lag(accel).over(w)) / 2.0 * (F.col("t") - F.lag("t").over(w)), F.lit(0.0))}, before=1)
    run = prefix(slab, keys, {"_c": ("sum", "_s")})
    got = windowed(run, keys, lambda w: {
        "_dv": F.lead("_c", width - 1).over(w) - F.col("_c"),
        "_dr": F.lead(velocity, width).over(w) - F.col(velocity)}, after=width)
    picked = got.filter((F.col("i") % stride == 0) & (F.col("i") < F.col("n") - width))
    return picked.groupBy(*keys).agg(F.corr("_dv", "_dr").alias("corr"), F.count(F.lit(1)).alias("windows"))


def up_down_balance(series: DataFrame, reps: DataFrame, keys: Sequence[str], velocity: str, least: float = 0.3) -> DataFrame:
    """Rising and falling area of each rep; balanced if the smaller is enough."""
    split = series.withColumns({
        "_up": F.greatest(F.col(velocity), F.lit(0.0)), "_down": F.least(F.col(velocity), F.lit(0.0))})
    up = interval_area(split, reps.select(*keys, "rep", "start_i", "stop_i"), keys, "_up", "up")
    down = interval_area(split, reps.select(*keys, "rep", "start_i", "stop_i"), keys, "_down", "down")
    both = up.select(*keys, "rep", "up").join(down.select(*keys, "rep", F.abs("down").alias("down")), [*keys, "rep"])
    return both.withColumn("balanced", F.least("up", "down") > least * F.greatest("up", "down"))


def nearest_to_median(rows: DataFrame, keys: Sequence[str], value: str, ident: str) -> DataFrame:
    """The row of each group closest to the group's median."""
    med = exact_medians(rows, keys, {"_m": value})
    x = salted_join(rows, med, keys, F.xxhash64(ident))
    far = F.abs(F.col(value) - F.col("_m"))
    return x.groupBy(*keys).agg(
        F.min_by(F.struct(ident, value), F.struct(far, F.col(ident))).alias("_r"), F.max("_m").alias("median")
    ).select(*keys, f"_r.{ident}", f"_r.{value}", "median")


def rep_identification(grid: DataFrame, partner: DataFrame, keys: Sequence[str], value: str, tile: int = 512) -> DataFrame:
    """Is a rep's true partner in the other recording also its nearest one?

    ``grid`` and ``partner`` hold one fixed-length array per (keys, rep); tiles
    are compared as matrices and only each rep's nearest distance leaves a task.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    keys = list(keys)
    a = grid.withColumn("_tile", F.floor(F.col("rep") / tile)).select(*keys, "rep", "_tile", F.col(value).alias("_v"))
    b = partner.withColumn("r_tile", F.floor(F.col("rep") / tile)).select(
        *[F.col(k).alias(f"r_{k}") for k in keys], F.col("rep").alias("r_rep"), "r_tile", F.col(value).alias("r_v"))
    tiles_a = a.groupBy(*keys).agg(F.max("_tile").alias("_top"))
    tiles_b = b.groupBy(*[f"r_{k}" for k in keys]).agg(F.max("r_tile").alias("r_top"))
    cond = [F.col(k) == F.col(f"r_{k}") for k in keys]
    tops = tiles_a.join(tiles_b, cond).select(*keys, "_top", "r_top")
    left = a.join(tops.select(*keys, "r_top"), keys).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "r_top"))).drop("r_top")
    right = b.join(tops.select(*[F.col(k).alias(f"r_{k}") for k in keys], "_top"), [f"r_{k}" for k in keys]).withColumn(
        "r_other", F.explode(F.sequence(F.lit(0).cast("long"), "_top"))).drop("_top")
    schema = T.StructType([*[grid.schema[k] for k in keys], T.StructField("rep", T.LongType()),
                           T.StructField("_d", T.DoubleType()), T.StructField("_near", T.LongType()),
                           T.StructField("_own", T.DoubleType())])

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        r = r.sort_values("r_rep")
        x, y = np.stack(l["_v"].to_numpy()), np.stack(r["r_v"].to_numpy())
        far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0.0))
        k = far.argmin(axis=1)
        same = l["rep"].to_numpy()[:, None] == r["r_rep"].to_numpy()[None]
        own = np.where(same.any(axis=1), np.where(same, far, 0.0).sum(axis=1), np.nan)
        return pd.DataFrame({**{c: l[c].iloc[0] for c in keys}, "rep": l["rep"].to_numpy(),
                             "_d": far[np.arange(len(l)), k], "_near": r["r_rep"].to_numpy()[k], "_own": own})

    parts = left.groupBy(*keys, "_tile", "_other").cogroup(
        right.groupBy(*[f"r_{k}" for k in keys], "r_other", "r_tile")).applyInPandas(compare, schema)
    return parts.groupBy(*keys, "rep").agg(
        F.min_by("_near", F.struct("_d", "_near")).alias("nearest"), F.min("_d").alias("distance")
    ).withColumn("identified", F.col("nearest") == F.col("rep"))


def demeaned(rows: DataFrame, keys: Sequence[str], place: str, values: Sequence[str]) -> DataFrame:
    """``values`` less their mean over the reps of a key at the same ``place``: what differs between reps."""
    mean = rows.groupBy(*keys, place).agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    x = salted_join(rows, mean, [*keys, place], F.col("rep"))
    return x.withColumns({v: F.col(v) - F.col(f"_m_{v}") for v in values}).drop(*[f"_m_{v}" for v in values])


def fixed_points_tail(n: Column, hits: Column) -> Column:
    """Chance that a random permutation of ``n`` things leaves ``hits`` or more in place, in closed form.

    Exactly j stay with chance 1/j! times the first n - j + 1 terms of exp(-1).
    """
    longest = 170  # 1/171! is 0 in double precision
    inverse = F.array(*[F.lit(1.0 / math.factorial(j)) for j in range(longest + 1)])
    partial, terms = 0.0, []
    for i in range(26):  # later terms do not change a double
        partial += (-1) ** i / math.factorial(i)
        terms.append(F.lit(partial))
    series = F.array(*terms)
    upto = F.least(n, hits + 40, F.lit(longest))
    few = F.when(hits <= upto, F.sequence(hits, upto)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(few, F.lit(0.0), lambda acc, j: acc + F.get(inverse, j.cast("int")) * F.get(series, F.least(n - j, F.lit(25)).cast("int")))


def identification_table(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reps, hits, p) from :func:`rep_identification`: how many reps find their own partner, and how
    likely as many would by a random matching of that key's reps."""
    hits = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("reps"), F.count_if("identified").alias("hits"))
    return hits.withColumn("p", fixed_points_tail(F.col("reps"), F.col("hits")))
