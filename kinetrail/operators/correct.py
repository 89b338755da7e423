"""Drift correction per repetition, at knots, and at impacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.motion import POSITION, VELOCITY, WORLD, double_integral
from kinetrail.plans.blocks import BLOCK, lookup, neighbours, ordinal, prefix, reblock, settle
from kinetrail.plans.joins import interval_join


def cut(series: DataFrame, reps: DataFrame, keys: Sequence[str], carry: Sequence[str] = (),
        ends: Sequence[str] = (), edge: int = 1) -> DataFrame:
    """Samples inside their windows, with ``rep, start_i, stop_i``, the row
    number ``j``, the time ``tau`` since the window opened and ``duration``.

    For every column in ``ends`` the rep's first value is attached as
    ``first_<c>`` and the change from the median of its first ``edge`` rows to
    that of its last as ``rise_<c>`` (``span`` is the matching time).  Each rep
    is summarised to one row and laid back over its samples.
    """
    keys = list(keys)
    bounds = reps.select(*keys, "rep", "start_i", "stop_i", *carry)
    size = F.col("stop_i") - F.col("start_i")
    e = F.greatest(F.least(F.lit(edge).cast("long"), F.floor(size / 2).cast("long")), F.lit(1).cast("long"))
    head, tail = F.col("i") < F.col("start_i") + e, F.col("i") >= F.col("stop_i") - e
    near = interval_join(series.select(*keys, "i", BLOCK, "t", *ends), bounds, keys).filter(head | tail)
    stats = near.groupBy(*bounds.columns).agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"),
        (F.avg(F.when(tail, F.col("t"))) - F.avg(F.when(head, F.col("t")))).alias("span"),
        *[F.min_by(c, "i").alias(f"first_{c}") for c in ends],
        # a median over at most ``edge`` rows; with one row it is that row
        *[((F.max_by(c, "i") - F.min_by(c, "i")) if edge == 1 else
           (F.median(F.when(tail, F.col(c))) - F.median(F.when(head, F.col(c))))).alias(f"rise_{c}") for c in ends])
    return interval_join(series, stats, keys).withColumns({
        "j": F.col("i") - F.col("start_i"), "tau": F.col("t") - F.col("t0"),
        "duration": F.col("t1") - F.col("t0")})


def detrend(
    series: DataFrame, reps: DataFrame, keys: Sequence[str], position: Sequence[str] = POSITION,
    axes: Sequence[int] = (0, 1, 2), edge: int = 1, order: int = 1,
    velocity: Sequence[str] | None = None, from_origin: bool = True, carry: Sequence[str] = (),
) -> DataFrame:
    """Remove the line (order 1) or parabola (order 2) joining a rep's ends.

    Order 2 also closes the velocity.  Reps of one row, or of no duration, are
    left as they are.  ``from_origin`` then moves each rep to start at zero
    (nothing is removed at its first row, so that is its own first value).
    """
    keys = list(keys)
    second = order >= 2 and velocity is not None
    values = [*position, *(velocity if second else ())]
    rows = cut(series, reps, keys, carry, values, edge)
    live = (F.col("stop_i") - F.col("start_i") >= 2) & (F.col("span") > 0)
    fixed = {}
    for k, p in enumerate(position):
        tau, span, d = F.col("tau"), F.col("span"), F.col(f"rise_{p}")
        drift = tau / span * d
        if second:
            dv = F.col(f"rise_{velocity[k]}")
            drift = dv / (2.0 * span) * tau * tau + (d / span - dv / 2.0) * tau
        moved = F.when(live, F.col(p) - drift).otherwise(F.col(p)) if k in axes else F.col(p)
        fixed[p] = moved - F.col(f"first_{p}") if from_origin else moved
    return rows.withColumns(fixed).drop("span", *[f"{x}_{v}" for v in values for x in ("first", "rise")])


def detrend_knots(series: DataFrame, knots: DataFrame, keys: Sequence[str],
                  position: Sequence[str] = POSITION) -> DataFrame:
    """Remove the piecewise-linear path through the knots, flat outside them.

    ``knots`` holds distinct row positions ``i``; fewer than two per key leave
    the key unchanged.
    """
    marks = knots.select(*keys, "i").distinct().withColumn("_knot", F.lit(True))
    x = series.join(marks, [*keys, "i"], "left")
    pack = F.when(F.col("_knot"), F.struct("i", "t", *position))
    x = prefix(x, keys, {"_b": ("last", pack), "_k": ("sum", F.coalesce(F.col("_knot").cast("long"), F.lit(0)))})
    x = settle(prefix(settle(x), keys, {"_a": ("last", pack)}, reverse=True))
    ref = x.filter("_knot and _k = 1").select(*keys, "n", *[F.col(p).alias(f"_r_{p}") for p in position])
    count = marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_knots"))
    x = lookup(x, keys, ref.join(count, list(keys)))
    b, a = F.col("_b"), F.col("_a")
    out = {}
    for p in position:
        frac = (F.col("t") - b["t"]) / (a["t"] - b["t"])
        at = F.when(b.isNull(), a[p]).when(a.isNull(), b[p]).when(a["i"] == b["i"], b[p]).otherwise(
            b[p] + (a[p] - b[p]) * frac)
        out[p] = F.when(F.col("_knots") >= 2, F.col(p) - (at - F.col(f"_r_{p}"))).otherwise(F.col(p))
    return x.withColumns(out).drop("_knot", "_b", "_k", "_a", "_knots", *[f"_r_{p}" for p in position])


def rest_knots(series: DataFrame, rests: DataFrame, holds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct knot rows: rest instants plus the middle of each hold,
    or the recording's end where a hold is missing.  ``holds``: keys, hold, mid_i."""
    ends = series.groupBy(*keys).agg(F.max("n").alias("n"))
    both = holds.groupBy(*keys).agg(
        F.max(F.when(F.col("hold") == "open", F.col("mid_i"))).alias("_o"),
        F.max(F.when(F.col("hold") == "close", F.col("mid_i"))).alias("_c"))
    outer = ends.join(both, list(keys), "left").select(*keys, "n", F.explode(F.array(
        F.coalesce("_o", F.lit(0)), F.coalesce("_c", F.col("n") - 1)).cast("array<long>")).alias("i"))
    inner = rests.select(*keys, "i").join(ends, list(keys)).select(*keys, "n", "i")
    return inner.unionByName(outer).filter("i >= 0 and i < n").select(*keys, "i").distinct()


def rest_windows(rests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-open windows from each rest instant to the next, both included."""
    paired = neighbours(reblock(rests), keys, {"_next": "i"}, step=1).filter("_next is not null")
    return ordinal(paired, keys, "rep").select(
        *keys, "rep", F.col("i").alias("start_i"), (F.col("_next") + 1).alias("stop_i"))


def parabola_coefficients(rows: DataFrame, keys: Sequence[str], values: Sequence[str], tau: Column,
                          duration: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Least-squares size of ``tau (tau - T) / 2`` per group, with r2 and tilt."""
    basis = tau * (tau - duration) / 2.0
    x = rows.withColumn("_b", basis)
    sums = x.groupBy(*keys).agg(
        F.sum(F.col("_b") * F.col("_b")).alias("_bb"),
        *[F.sum(F.col("_b") * F.col(v)).alias(f"_by_{v}") for v in values],
        *[F.sum(F.col(v) * F.col(v)).alias(f"_yy_{v}") for v in values],
        *[(F.max(v) - F.min(v)).alias(f"excursion_{v}") for v in values], *extra,
    )
    out = {}
    for v in values:
        c = F.when(F.col("_bb") > 0, F.col(f"_by_{v}") / F.col("_bb")).otherwise(0.0)
        # residual of a one-term fit: yy - 2 c by + c c bb
        resid = F.col(f"_yy_{v}") - 2.0 * c * F.col(f"_by_{v}") + c * c * F.col("_bb")
        out[f"c_{v}"] = c
        out[f"r2_{v}"] = F.when(F.col(f"_yy_{v}") > 0, 1.0 - resid / F.col(f"_yy_{v}")).otherwise(0.0)
        out[f"tilt_deg_{v}"] = F.degrees(F.asin(F.least(F.lit(1.0), F.abs(c) / 9.80665)))
    return sums.withColumns(out).drop("_bb", *[f"_{p}_{v}" for p in ("by", "yy") for v in values])


def remove_parabola(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Subtract each rep's own parabola (true sample times), then its start."""
    fit = parabola_coefficients(
        rows, [*keys, "rep", "start_i", "stop_i"], values, F.col("tau"), F.col("duration"),
        [F.min_by(v, "j").alias(f"_f_{v}") for v in values])
    table = fit.select(*keys, F.col("rep").alias("_rep"), F.col("start_i").alias("_s"), F.col("stop_i").alias("_e"),
                       *[F.col(f"c_{v}").alias(f"_c_{v}") for v in values], *[f"_f_{v}" for v in values])
    x = interval_join(rows, table, keys, "_s", "_e").filter("_rep = rep")
    basis = F.col("tau") * (F.col("tau") - F.col("duration")) / 2.0
    # the parabola is zero at the rep's first row, so the start stays its value
    return x.withColumns({v: F.col(v) - F.col(f"_c_{v}") * basis - F.col(f"_f_{v}") for v in values}).drop(
        "_rep", "_s", "_e", *[f"_{p}_{v}" for p in "cf" for v in values])


def jump_windows(rests: DataFrame, impact_rows: DataFrame, series: DataFrame, keys: Sequence[str],
                 width_s: float | None = None) -> DataFrame:
    """Where each rest-to-rest velocity error is spread: ``[start_i, stop_i)``.

    Without a width, the whole interval; with one, from the last impact inside
    for that long (at least one step).  ``series`` carries ``dt``-based median
    spacing as column ``dt_median`` per row when a width is used.
    """
    pair = neighbours(reblock(rests.select(*keys, "n", "i", "t")), keys, {"i1": "i", "t1": "t"}, step=1)
    pair = pair.filter("i1 is not null").select(*keys, "n", F.col("i").alias("i0"), F.col("t").alias("t0"), "i1", "t1")
    if width_s is None:
        return pair.select(*keys, "i0", "i1", F.col("i0").alias("a"), F.col("i1").alias("b"))
    if width_s < 0:
        return pair.filter(F.lit(False)).select(*keys, "i0", "i1", F.col("i0").alias("a"), F.col("i1").alias("b"))
    # latest impact at or before each closing rest, if later than the opening one
    marks = impact_rows.select(*keys, "i", F.col("i").alias("_imp"), F.lit(None).cast("struct<i0:long,i1:long>").alias("_p"))
    asks = pair.select(*keys, F.col("i1").alias("i"), F.lit(None).cast("long").alias("_imp"), F.struct("i0", "i1").alias("_p"))
    merged = reblock(marks.unionByName(asks)).withColumn("_side", F.when(F.col("_p").isNull(), 0).otherwise(1))
    found = prefix(merged, keys, {"_a": ("last", "_imp")}, order=("i", "_side")).filter("_p is not null")
    inside = found.select(*keys, "_p.*", F.col("_a").alias("a")).filter("a > i0")
    step = series.groupBy(*keys).agg(F.max("dt_median").alias("_dtm"))
    long = F.greatest(F.lit(1), F.bround(F.lit(float(width_s)) / F.col("_dtm"))).cast("long")
    end = F.least(F.col("i1"), F.col("a") + long) if width_s > 0 else F.col("a") + 1
    return inside.join(step, list(keys)).select(*keys, "i0", "i1", "a", end.alias("b"))


def spread_jumps(series: DataFrame, windows: DataFrame, keys: Sequence[str], axes: Sequence[int] = (0, 1),
                 world: Sequence[str] = WORLD, velocity: Sequence[str] = VELOCITY,
                 position: Sequence[str] = POSITION) -> DataFrame:
    """Subtract from the acceleration the constant that removes each interval's
    velocity error over its window, then integrate again."""
    ends = windows.select(*keys, "i0", "i1", "a", "b", F.explode(F.array(*[
        F.struct(F.lit(c).alias("_end"), F.col(c).alias("start_i"), (F.col(c) + 1).alias("stop_i"))
        for c in ("i0", "i1", "a", "b")])).alias("_e")).select(*keys, "i0", "i1", "a", "b", "_e.*")
    read = interval_join(series.select(*keys, "i", BLOCK, "t", *velocity), ends, keys)
    group = [*keys, "i0", "i1", "a", "b"]

    def at(end: str, c: str) -> Column:
        return F.max(F.when(F.col("_end") == end, F.col(c)))

    steps = read.groupBy(*group).agg(
        (at("b", "t") - at("a", "t")).alias("_span"),
        *[(at("i1", velocity[k]) - at("i0", velocity[k])).alias(f"_dv{k}") for k in axes])
    steps = steps.filter("_span > 0").select(
        *keys, F.col("a").alias("_s"), (F.col("b") + 1).alias("_e"),
        *[(F.col(f"_dv{k}") / F.col("_span")).alias(f"_c{k}") for k in axes])
    hit = interval_join(series.select(*keys, "i", BLOCK), steps, keys, "_s", "_e").groupBy(*keys, "i").agg(
        *[F.sum(f"_c{k}").alias(f"_c{k}") for k in axes])
    fixed = series.join(hit, [*keys, "i"], "left").withColumns({
        world[k]: F.col(world[k]) - F.coalesce(F.col(f"_c{k}"), F.lit(0.0)) for k in axes})
    keep = [c for c in series.columns if c not in (*velocity, *position)]
    return double_integral(fixed.select(*keep), keys, world, velocity, position)


def splice_velocity(series: DataFrame, rests: DataFrame, impact_rows: DataFrame, keys: Sequence[str],
                    velocity: Sequence[str] = VELOCITY, axes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Force zero velocity at every rest, ramping each correction in from the
    impact before it.

    Each step would read the velocity left by the earlier ones, so it removes
    ``v[rest] - v[previous rest]``; corrections add up, and past its rest one
    is a constant (a running sum).
    """
    marks = impact_rows.select(*keys, "i", F.lit(0).alias("_side"), F.struct("i", "t").alias("_imp"))
    asks = rests.select(*keys, "i", F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_imp"].dataType).alias("_imp"))
    # an impact exactly at the rest does not own it: sort it after the rest
    merged = reblock(marks.withColumn("_side", F.lit(2)).unionByName(asks))
    owned = prefix(merged, keys, {"_own": ("last", "_imp")}, order=("i", "_side")).filter(
        "_side = 1 and _own is not null").select(*keys, "i", BLOCK, F.col("_own.i").alias("_k"), F.col("_own.t").alias("_tk"))
    at = series.select(*keys, "i", F.col("t").alias("_tr"), *[F.col(velocity[k]).alias(f"_v{k}") for k in axes])
    read = owned.join(at, [*keys, "i"])
    prev = neighbours(read, keys, {f"_p{k}": f"_v{k}" for k in axes})
    steps = prev.withColumns({f"_e{k}": F.col(f"_v{k}") - F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) for k in axes})
    # ramp part: rows from the impact up to the rest
    ramp = steps.select(*keys, F.col("_k").alias("_s"), (F.col("i") + 1).alias("_e"), "_tk", "_tr", *[f"_e{k}" for k in axes])
    share = (F.col("t") - F.col("_tk")) / (F.col("_tr") - F.col("_tk"))
    ramped = interval_join(series.select(*keys, "i", BLOCK, "t"), ramp, keys, "_s", "_e").groupBy(*keys, "i").agg(
        *[F.sum(share * F.col(f"_e{k}")).alias(f"_r{k}") for k in axes])
    # constant part: rows after the rest
    done = steps.select(*keys, "i", *[F.col(f"_e{k}").alias(f"_d{k}") for k in axes])
    x = series.join(ramped, [*keys, "i"], "left").join(done, [*keys, "i"], "left")
    x = prefix(x, keys, {f"_o{k}": ("sum", F.coalesce(F.col(f"_d{k}"), F.lit(0.0))) for k in axes}, inclusive=False)
    fixed = {
        velocity[k]: F.col(velocity[k]) - F.coalesce(F.col(f"_r{k}"), F.lit(0.0)) - F.coalesce(F.col(f"_o{k}"), F.lit(0.0))
        for k in axes}
    return x.withColumns(fixed).select(*series.columns)
