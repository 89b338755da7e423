"""Ordered operators on a blocked series: rolling statistics, smoothing,
gradients, quiet windows, runs and lobes.

A window wider than a block is summed from running totals (:func:`wide_sums`)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.operators.motion import GYRO, magnitude
from kinetrail.plans.blocks import (
    BLOCK, block_rows, lookup, neighbours, ordinal, per_key, prefix, reblock, runs, settle, windowed,
)

_SCALE = 1 << 20   # window lengths are measured in units of 1 / _SCALE

# frames over ``_u`` that hold exactly ``_w`` rows (neighbours differ by at
# least _SCALE / halo units, far above the rounding slack of 2)
CENTRED = (-(_SCALE // 2) - 2, _SCALE // 2 - 3)
FORWARD = (-2, _SCALE - 3)
AROUND = (-_SCALE - 2, _SCALE - 3)


def frame_rows(seconds: float, least: int, fs: Column | str = "fs") -> Column:
    """Window length in rows: rounded half to even, at least ``least``."""
    rate = F.col(fs) if isinstance(fs, str) else fs
    return F.greatest(F.bround(F.lit(float(seconds)) * rate).cast("long"), F.lit(least).cast("long"))


def widest(series: DataFrame, width: Column) -> int:
    """Rows of the widest window of the data (one number); they border a block."""
    return int(series.agg(F.max(width)).first()[0] or 1)


def _ranked(score: Column | str) -> Column:
    """A score as it is compared: nine places, so that the order in which a sum was added decides nothing."""
    return F.round(score, 9) + F.lit(0.0)


def wide_sums(x: DataFrame, keys: Sequence[str], sums: dict[str, Column], lo: Column, hi: Column) -> DataFrame:
    """Sums over the rows ``lo`` to ``hi`` of the key (clipped), for windows wider than a block.

    A window is the running total at its last row less the one before its first;
    both are met by position, so its width neither copies rows nor costs time.
    Nulls count as nothing.  A window that holds a NaN or an infinity gives NaN, and
    others are not touched by it.  A window beyond the key's rows sums what is there.
    """
    totals: dict[str, tuple[str, Column]] = {}
    for o, c in sums.items():
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        totals[f"_sum_{o}"] = ("sum", F.when(~odd, c))
        totals[f"_odd_{o}"] = ("sum", odd.cast("long"))
    first, last = F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, F.col("n") - 1).cast("long")
    run = settle(prefix(x.withColumns({"_first": first, "_last": last}), keys, totals))
    ends = run.select(*keys, "i", F.struct(*[F.coalesce(F.col(o).cast("double"), F.lit(0.0)).alias(o) for o in totals]).alias("_c"))
    at_last = ends.select(*keys, F.col("i").alias("_last"), F.col("_c").alias("_up"))
    before = ends.select(*keys, (F.col("i") + 1).alias("_first"), F.col("_c").alias("_down"))
    met = run.drop(*totals).join(at_last, [*keys, "_last"], "left").join(before, [*keys, "_first"], "left")

    def between(name: str) -> Column:
        return F.col(f"_up.{name}") - F.coalesce(F.col(f"_down.{name}"), F.lit(0.0))

    return met.withColumns({o: F.when(between(f"_odd_{o}") > 0, float("nan")).otherwise(between(f"_sum_{o}")) for o in sums}).drop(
        "_first", "_last", "_up", "_down")


def _wide_variance(x: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """:func:`rolling_variance` of ``_x_*`` by :func:`wide_sums`, taken from the key's first finite value."""
    def plain(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    ends = per_key(x, keys, *[f(F.col(f"_x_{o}"), at).alias(f"_{t}_{o}") for o in values for f, at, t in (
        (F.min_by, F.col("i"), "a"), (F.max_by, F.col("i"), "b"), (F.min_by, F.when(plain(F.col(f"_x_{o}")), F.col("i")), "c"))])
    met = lookup(x, keys, ends)
    pad = F.floor(F.col("_w") / 2)
    sums, out = {}, {}
    left = F.greatest(pad - F.col("i"), F.lit(0))
    right = F.greatest(F.col("i") + F.col("_w") - pad - F.col("n"), F.lit(0))
    for o in values:
        a, b, shift = F.col(f"_a_{o}"), F.col(f"_b_{o}"), F.coalesce(F.col(f"_c_{o}"), F.lit(0.0))
        sums[f"_s1_{o}"] = F.col(f"_x_{o}") - shift
        sums[f"_s2_{o}"] = sums[f"_s1_{o}"] * sums[f"_s1_{o}"]
        # beyond the key's ends the end values repeat; an end counts only where it does
        s1, s2 = F.col(f"_s1_{o}"), F.col(f"_s2_{o}")
        for times, end in ((left, a - shift), (right, b - shift)):
            s1 = s1 + F.when(times > 0, times * end).otherwise(0.0)
            s2 = s2 + F.when(times > 0, times * end * end).otherwise(0.0)
        mean = s1 / F.col("_w")
        out[o] = F.greatest(s2 / F.col("_w") - mean * mean, F.lit(0.0))
    got = wide_sums(met, keys, sums, F.col("i") - pad, F.col("i") - pad + F.col("_w") - 1).withColumns(out)
    return got.drop(*sums, *[f"_{t}_{o}" for o in values for t in "abc"])


def _scaled(series: DataFrame, width: Column) -> DataFrame:
    """``_w``, the window length of the key.  With ``_u``, the position inside the
    block measured in window lengths, a frame of ``_w`` rows is a fixed range of
    ``_u``, although ``_w`` differs from key to key.
    """
    return series.withColumn("_w", width)


def _position(rows: int) -> Column:
    return F.floor((F.col("i") - F.col(BLOCK) * rows) * _SCALE / F.col("_w"))


def rolling_variance(
    series: DataFrame, keys: Sequence[str], values: dict[str, Column], width: Column,
    halo: int | None = None,
) -> DataFrame:
    """Centred rolling population variance, end values repeated, floor at 0.

    ``values`` maps output name -> column; ``width`` is a per-key row count; ``halo`` its
    maximum, if known.
    """
    rows = block_rows(series.sparkSession)
    halo = widest(series, width) if halo is None else halo
    x = _scaled(series.withColumns({f"_x_{o}": c for o, c in values.items()}), width)
    if halo > rows:
        return _wide_variance(x, keys, list(values)).drop("_w", *[f"_x_{o}" for o in values])

    def build(w):
        frame = W.partitionBy(*keys, BLOCK).orderBy("_u").rangeBetween(*CENTRED)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        pad = F.floor(F.col("_w") / 2)
        left = F.greatest(pad - F.col("i"), F.lit(0))
        right = F.greatest(F.col("i") + F.col("_w") - pad - F.col("n"), F.lit(0))
        out = {}
        for o in values:
            v = F.col(f"_x_{o}")
            # the block's ends are the key's ends wherever the pad is non-zero
            a, b = F.first(v).over(whole), F.last(v).over(whole)
            s1 = F.sum(v).over(frame) + left * a + right * b
            s2 = F.sum(v * v).over(frame) + left * a * a + right * b * b
            mean = s1 / F.col("_w")
            out[o] = F.greatest(s2 / F.col("_w") - mean * mean, F.lit(0.0))
        return out

    staged = windowed_scaled(x, keys, build, halo, halo, rows)
    return staged.drop("_w", "_u", *[f"_x_{o}" for o in values])


def windowed_scaled(x: DataFrame, keys, build, before: int, after: int, rows: int) -> DataFrame:
    """:func:`windowed`, with ``_u`` computed after the border rows are copied."""
    first = F.greatest(F.floor((F.col("i") - after) / rows), F.lit(0)).cast("long")
    last = F.least(
        F.floor((F.col("i") + before) / rows), F.floor((F.col("n") - 1) / rows)).cast("long")
    copied = x.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn("_u", _position(rows))
    w = W.partitionBy(*keys, BLOCK).orderBy("i")
    own = F.col(BLOCK) == F.floor(F.col("i") / rows)
    return copied.withColumns(build(w)).filter(own)


def rolling_mean(
    series: DataFrame, keys: Sequence[str], value: str, out: str, length: int, edge: str = "repeat",
) -> DataFrame:
    """Centred mean of odd ``length``; ends repeat the end value, or pad zeros."""
    half = length // 2

    def build(w):
        frame = w.rowsBetween(-half, length - 1 - half)
        total = F.sum(value).over(frame)
        if edge == "repeat":
            whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            left = F.greatest(F.lit(half) - F.col("i"), F.lit(0))
            right = F.greatest(F.col("i") + half - F.col("n") + 1, F.lit(0))
            total = total + left * F.first(value).over(whole) + right * F.last(value).over(whole)
        return {out: total / length}

    return windowed(series, keys, build, before=half, after=half)


def fill_gaps(series: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Fill null/NaN by interpolation over the row position, ends clamped."""
    good = F.col(value).isNotNull() & ~F.isnan(value)
    packed = F.when(good, F.struct("i", F.col(value).alias("v")))
    back = prefix(series, keys, {"_b": ("last", packed)})
    both = prefix(back, keys, {"_f": ("last", packed)}, reverse=True)
    b, f = F.col("_b.v"), F.col("_f.v")
    frac = (F.col("i") - F.col("_b.i")) / (F.col("_f.i") - F.col("_b.i"))
    filled = F.when(F.col("_b").isNull(), f).when(F.col("_f").isNull(), b).when(
        F.col("_b.i") == F.col("_f.i"), b).otherwise(b + (f - b) * frac)
    return both.withColumn(out, filled).drop("_b", "_f")


def smooth(series: DataFrame, keys: Sequence[str], value: str, out: str, length: int) -> DataFrame:
    """Gap-filled centred mean with repeated ends."""
    filled = fill_gaps(series, keys, value, "_filled")
    return rolling_mean(filled, keys, "_filled", out, length).drop("_filled")


def gradient(series: DataFrame, keys: Sequence[str], value: str, out: str, time: str = "t") -> DataFrame:
    """Second-order central difference on irregular time, one-sided at the ends."""
    def build(w):
        f, t = F.col(value), F.col(time)
        fb, fa = F.lag(value).over(w), F.lead(value).over(w)
        hs, hd = t - F.lag(time).over(w), F.lead(time).over(w) - t
        centre = (hs * hs * fa + (hd * hd - hs * hs) * f - hd * hd * fb) / (hs * hd * (hd + hs))
        return {out: F.when(hs.isNull(), (fa - f) / hd).when(hd.isNull(), (f - fb) / hs).otherwise(centre)}

    return windowed(series, keys, build, before=1, after=1)


def _hat_matrix(length: int, order: int) -> np.ndarray:
    x = np.vander(np.arange(length) - length // 2, order + 1).astype(float)
    return x @ np.linalg.pinv(x)


def polynomial_smooth(
    series: DataFrame, keys: Sequence[str], value: str, out: str, length: int = 9, order: int = 3,
) -> DataFrame:
    """Local polynomial (Savitzky-Golay) smoothing; ends use the end fit.

    Null where the key has fewer rows than the window.
    """
    half, hat = length // 2, _hat_matrix(length, order)

    def build(w):
        def at(offset: int) -> Column:
            return F.lead(value, offset).over(w) if offset >= 0 else F.lag(value, -offset).over(w)

        def fit(row: int) -> Column:
            total = F.lit(0.0)
            for j in range(length):
                total = total + F.lit(float(hat[row, j])) * at(j - row)
            return total

        result = fit(half)
        for row in range(half):
            result = F.when(F.col("i") == row, fit(row)).otherwise(result)
            back = length - 1 - row
            result = F.when(F.col("i") == F.col("n") - 1 - row, fit(back)).otherwise(result)
        return {out: F.when(F.col("n") >= length, result)}

    return windowed(series, keys, build, before=length - 1, after=length - 1)


def stillest_window(
    series: DataFrame, keys: Sequence[str], search_s: float = 3.0, window_s: float = 1.0,
    least: int = 5, value: Column | None = None,
) -> DataFrame:
    """``[start_i, stop_i)`` of lowest variance in the opening ``search_s``; the
    earliest of those equal to nine places."""
    rows = block_rows(series.sparkSession)
    mag = magnitude(GYRO) if value is None else value
    base = per_key(
        series, keys, F.max("fs").alias("_fs"),
        F.sum(F.when(F.col("t") < search_s, 1).otherwise(0)).cast("long").alias("_end"),
    ).withColumn("_len", frame_rows(window_s, least, "_fs"))
    opening = lookup(
        series.filter(F.col("t") < search_s).select(*keys, "i", "n", BLOCK, mag.alias("_x")),
        keys, base.select(*keys, "n", "_end", "_len"),
    )
    halo = widest(base, F.col("_len"))
    x = _scaled(opening, F.col("_len"))

    def build(w):
        frame = W.partitionBy(*keys, BLOCK).orderBy("_u").rangeBetween(*FORWARD)
        mean = F.sum("_x").over(frame) / F.col("_w")
        return {"_var": F.sum(F.col("_x") * F.col("_x")).over(frame) / F.col("_w") - mean * mean}

    if halo > rows:
        mean = F.col("_s1") / F.col("_w")
        scored = wide_sums(x, keys, {"_s1": F.col("_x"), "_s2": F.col("_x") * F.col("_x")}, F.col("i"), F.col("i") + F.col("_w") - 1).withColumn(
            "_var", F.col("_s2") / F.col("_w") - mean * mean)
    else:
        scored = windowed_scaled(x, keys, build, 0, halo, rows)
    scored = scored.filter(F.col("i") <= F.col("_end") - F.col("_w"))
    best = scored.groupBy(*keys).agg(F.min_by("i", F.struct(_ranked("_var"), "i")).alias("_best"))
    short = F.col("_end") <= F.col("_len")
    start = F.when(short, F.lit(0)).otherwise(F.col("_best"))
    return base.join(best, list(keys), "left").select(
        *keys, "n", start.cast("long").alias("start_i"),
        F.when(short, F.greatest("_end", "_len")).otherwise(start + F.col("_len")).cast("long").alias("stop_i"),
    )


def hold_windows(
    series: DataFrame, keys: Sequence[str], span_s: float = 1.5,
) -> DataFrame:
    """Quietest ``span_s`` inside the opening (0) and closing (2) phase, the earliest of those equal to nine places.

    Rows of the chosen windows, with ``hold`` (open/close), ``rank`` in the
    phase, ``start_k`` and ``len``.  Absent or short phases give no rows.
    """
    rows = block_rows(series.sparkSession)
    label = F.when(F.col("phase") == 0, "open").when(F.col("phase") == 2, "close")
    part = [*keys, "hold"]
    held = ordinal(
        series.withColumn("hold", label).filter("hold is not null"), part, "_rank")
    size = held.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"), F.max("fs").alias("_fs"))
    size = size.withColumn("_len", F.floor(F.lit(span_s) * F.col("_fs")).cast("long"))
    ranked = reblock(
        held.withColumn("_i", F.col("i")).withColumn("i", F.col("_rank")).drop("_rank", "n"))
    size = size.withColumn("n", F.col("_size")).filter(F.col("_size") >= F.col("_len") + 2)
    ranked = lookup(ranked, part, size.select(*part, "n", "_len", "_size"), "inner")
    halo = widest(size, F.col("_len"))
    x = _scaled(ranked.withColumn("n", F.col("_size")).withColumn("_x", magnitude(GYRO)), F.greatest(F.col("_len"), F.lit(1)))

    def build(w):
        frame = W.partitionBy(*part, BLOCK).orderBy("_u").rangeBetween(*FORWARD)
        return {"_score": F.sum("_x").over(frame) / F.col("_w")}

    if halo > rows:
        scored = wide_sums(x, part, {"_sum": F.col("_x")}, F.col("i"), F.col("i") + F.col("_w") - 1).withColumn(
            "_score", F.col("_sum") / F.col("_w")).drop("_sum")
    else:
        scored = windowed_scaled(x, part, build, 0, halo, rows)
    best = scored.filter(F.col("i") <= F.col("n") - F.col("_w")).groupBy(*part).agg(
        F.max("n").alias("n"), F.min_by("i", F.struct(_ranked("_score"), "i")).alias("start_k"))
    picked = lookup(scored.drop("_score", "_u", "_x"), part, best, "inner").filter(
        (F.col("i") >= F.col("start_k")) & (F.col("i") < F.col("start_k") + F.col("_w")))
    return picked.withColumn("rank", F.col("i")).withColumn("i", F.col("_i")).withColumn(
        "len", F.col("_w")).drop("_i", "_w", "_len", "_size", "_u", "n")


def quietest_slide(
    series: DataFrame, keys: Sequence[str], value: Column, span_s: float = 8.0, slide_s: float = 0.5,
    least: int = 10,
) -> DataFrame:
    """Start of the quietest ``span_s`` over starts every ``slide_s``, the earliest of those
    whose variance is equal to nine places.

    Each row is added to the few windows that contain it, so the sliding
    statistic is one grouped aggregate.
    """
    ends = per_key(series, keys, F.max("t").alias("_end"))
    x = lookup(series.select(*keys, "i", "n", BLOCK, "t", value.alias("_x")), keys, ends)
    lo = F.greatest(F.floor((F.col("t") - span_s) / slide_s) + 1, F.lit(0)).cast("long")
    hi = F.floor(F.col("t") / slide_s).cast("long")
    laid = x.filter(lo <= hi).withColumn("_k", F.explode(F.sequence(lo, hi))).filter(
        F.col("_k") * slide_s < F.greatest(F.col("_end") - span_s, F.lit(0.1)))
    scored = laid.groupBy(*keys, "_k").agg(
        F.stddev_pop("_x").alias("_s"), F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= least)
    return scored.groupBy(*keys).agg(
        (F.min_by("_k", F.struct(_ranked(F.col("_s") * F.col("_s")), "_k")) * slide_s).alias("start_t"), F.min("_s").alias("spread"))


def drop_short(series: DataFrame, keys: Sequence[str], mask: Column, shortest: Column, out: str) -> DataFrame:
    """Mask with its runs shorter than ``shortest`` rows switched off."""
    marked = windowed(
        series.withColumn("_on", F.coalesce(mask, F.lit(False))), keys,
        lambda w: {
            "_open": F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), F.col("i")),
            "_close": F.when(F.col("_on") & ~F.coalesce(F.lead("_on").over(w), F.lit(False)), F.col("i")),
        }, before=1, after=1)
    back = prefix(marked, keys, {"_from": ("last", "_open")})
    both = prefix(back, keys, {"_to": ("last", "_close")}, reverse=True)
    length = F.col("_to") - F.col("_from") + 1
    return both.withColumn(out, F.col("_on") & (length >= shortest)).drop(
        "_on", "_open", "_close", "_from", "_to")


def stationary_mask(
    series: DataFrame, keys: Sequence[str], accel: Column, gyro: Column, window_s: float = 0.25,
    accel_var_max: float = 0.05, gyro_var_max: float = 0.002, min_s: float = 0.20,
    out: str = "still",
) -> DataFrame:
    rolled = rolling_variance(
        series, keys, {"_av": accel, "_gv": gyro}, frame_rows(window_s, 3))
    quiet = (F.col("_av") < accel_var_max) & (F.col("_gv") < gyro_var_max)
    shortest = F.bround(F.lit(min_s) * F.col("fs")).cast("long")
    return drop_short(rolled, keys, quiet, shortest, out).drop("_av", "_gv")


def lobes(
    series: DataFrame, keys: Sequence[str], value: str, time: str = "t", min_area: float = 0.08,
    min_rows: int = 5,
) -> DataFrame:
    """Runs of one sign with their signed area; zero counts as positive.

    ``lobe`` numbers the surviving lobes in order; ``peak_i`` is the first
    extreme of the lobe's own sign.
    """
    v, t = F.col(value), F.col(time)

    def build(w):
        up, was = v >= 0, F.lag(v >= 0).over(w)
        same = F.coalesce(up == was, F.lit(False))
        slab = (v + F.lag(value).over(w)) / 2.0 * (t - F.lag(time).over(w))
        return {"_new": (~same).cast("long"), "_slab": F.when(same, slab).otherwise(0.0)}

    marked = prefix(windowed(series, keys, build, before=1), keys, {"_run": ("sum", "_new")})
    found = marked.groupBy(*keys, "_run").agg(
        F.min("i").alias("start_i"), (F.max("i") + 1).alias("stop_i"), F.sum("_slab").alias("area"),
        F.min_by(F.struct("i", time), F.struct(-v, F.col("i"))).alias("_hi"),
        F.min_by(F.struct("i", time), F.struct(v, F.col("i"))).alias("_lo"),
        F.max(F.abs(v)).alias("peak"),
    ).filter((F.col("stop_i") - F.col("start_i") >= min_rows) & (F.abs("area") >= min_area))
    top = F.when(F.col("area") > 0, F.col("_hi")).otherwise(F.col("_lo"))
    shaped = reblock(found.select(
        *keys, top["i"].alias("peak_i"), top[time].alias("peak_t"), "start_i", "stop_i", "area", "peak"
    ), "start_i")
    return ordinal(shaped, keys, "lobe", order=("start_i",))


def local_maxima(series: DataFrame, keys: Sequence[str], value: str, least: Column | None = None) -> DataFrame:
    """Interior rows not below either neighbour (and passing ``least``)."""
    marked = windowed(series, keys, lambda w: {
        "_peak": (F.col(value) >= F.lag(value).over(w)) & (F.col(value) >= F.lead(value).over(w))
    }, before=1, after=1)
    test = F.coalesce(F.col("_peak"), F.lit(False))
    if least is not None:
        test = test & least
    return marked.filter(test).drop("_peak")


def dwells(series: DataFrame, keys: Sequence[str], velocity: str, time: str = "t",
           slow: float = 0.10, min_s: float = 0.20) -> DataFrame:
    """Runs with ``|v|`` below ``slow`` lasting ``min_s``; their mid time."""
    found = runs(series, keys, F.abs(velocity) < slow, [F.min(time).alias("t0"), F.max(time).alias("t1")])
    return found.filter(F.col("t1") - F.col("t0") >= min_s).withColumn(
        "mid", (F.col("t0") + F.col("t1")) * 0.5)
