"""Putting a referee track on the recording's clock."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.operators.windows import gradient, smooth
from kinetrail.plans.blocks import BLOCK, block_rows, lookup, ordinal, per_key, reblock, settle, windowed
from kinetrail.plans.scans import each_group, numbers, zero_phase_band

# fixed values of the lag search
SYNC_FS, SYNC_LO, SYNC_HI = 200.0, 0.15, 5.0
MIN_OVERLAP_S, MIN_OVERLAP_REPS = 2.0, 3.0
MAX_LAG_S, WIDEN, STABLE_S = 11.75, 1.6, 0.25
RIVAL_FRACTION, RIVAL_GUARD_S, PERIOD_TOLERANCE = 0.70, 0.4, 0.15


def match_events(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Pair two event lists by position, truncated to the shorter."""
    a = ordinal(left, keys, "k").select(*keys, "k", F.col(time).alias("left_t"))
    b = ordinal(right, keys, "k").select(*keys, "k", F.col(time).alias("right_t"))
    return a.join(b, [*keys, "k"])


def affine_fit(pairs: DataFrame, keys: Sequence[str], clip_t: str = "left_t", log_t: str = "right_t") -> DataFrame:
    """``clip = slope * log + offset`` per key; below two pairs: refused."""
    fit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.regr_slope(clip_t, log_t).alias("slope"), F.regr_intercept(clip_t, log_t).alias("offset"))
    resid = F.col(clip_t) - (F.col("slope") * F.col(log_t) + F.col("offset"))
    rms = pairs.join(fit, list(keys)).groupBy(*keys).agg(
        (F.sqrt(F.avg(resid * resid)) * 1000.0).alias("rms_ms"))
    return fit.join(rms, list(keys)).withColumns({
        "drift_pct": (F.col("slope") - 1.0) * 100.0, "refused": F.col("events") < 2})


def to_log_time(track: DataFrame, fit: DataFrame, keys: Sequence[str], time: str = "t", out: str = "t") -> DataFrame:
    """Clip time to log time through ``(t - offset) / slope``."""
    n = per_key(track, keys)
    x = lookup(track, keys, n.join(fit.select(*keys, "slope", "offset"), list(keys)))
    return x.withColumn(out, (F.col(time) - F.col("offset")) / F.col("slope")).drop("slope", "offset")


def uniform_grid(series: DataFrame, keys: Sequence[str], values: Sequence[str], rate: float,
                 time: str = "t", origin: str | None = None, half_open: bool = True) -> DataFrame:
    """Linear resampling to ``origin + k / rate``; ``i`` becomes ``k``.

    Each pair of neighbouring samples emits the grid points between them, so
    the resampling is a map after one neighbour lookup.  ``origin`` names a
    column (default: the key's first time).
    """
    bounds = per_key(series, keys, F.min(time).alias("_t0"), F.max(time).alias("_t9"))
    x = windowed(series, keys, lambda w: {
        "_ta": F.lead(time).over(w), **{f"_n_{v}": F.lead(v).over(w) for v in values}}, after=1)
    x = lookup(x.filter("_ta is not null"), keys, bounds)
    start = F.col(origin) if origin else F.col("_t0")
    eps = 1e-9
    lo = F.ceil((F.col(time) - start) * rate - eps)
    hi = F.ceil((F.col("_ta") - start) * rate - eps) - 1
    if not half_open:
        hi = F.when(F.col("_ta") == F.col("_t9"), F.floor((F.col("_ta") - start) * rate + eps)).otherwise(hi)
    laid = x.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_lo <= _hi").withColumn(
        "_k", F.explode(F.sequence("_lo", "_hi")))
    at = start + F.col("_k") / rate
    frac = F.when(F.col("_ta") > F.col(time), (at - F.col(time)) / (F.col("_ta") - F.col(time))).otherwise(0.0)
    got = laid.select(
        *keys, F.col("_k").alias("i"), at.alias(time),
        *[(F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * frac).alias(v) for v in values])
    first = got.groupBy(*keys).agg(F.min("i").alias("_i0"), F.count(F.lit(1)).alias("n"))
    out = reblock(got).join(first, list(keys)).withColumn("k", F.col("i")).withColumn("i", F.col("i") - F.col("_i0"))
    return reblock(out.drop("_i0", BLOCK))


def lag_curve(left: DataFrame, right: DataFrame, keys: Sequence[str], value_left: str, value_right: str,
              max_lag: int, grid: str = "k", need: Column | int = 2) -> DataFrame:
    """Pearson correlation of ``left[g]`` with ``right[g + lag]`` for every lag.

    A block of ``left`` meets the stretch of ``right`` it can reach and returns
    six running sums per lag (by FFT); sums of all blocks then add up.  No
    sample pair ever leaves a task.  Null below ``need`` overlapping points.
    """
    keys = list(keys)
    rows = block_rows(left.sparkSession)
    blk = F.floor(F.col(grid) / rows).cast("long")
    a = left.select(*keys, F.col(grid).alias("_g"), F.col(value_left).cast("double").alias("_v"), blk.alias(BLOCK))
    b = right.select(*keys, F.col(grid).alias("_g"), F.col(value_right).cast("double").alias("_v"))
    b = b.withColumn(BLOCK, F.explode(F.sequence(
        F.floor((F.col("_g") - max_lag) / rows).cast("long"), F.floor((F.col("_g") + max_lag) / rows).cast("long"))))
    sums = ["_n", "_a", "_b", "_ab", "_aa", "_bb"]
    schema = T.StructType([
        *[left.schema[k] for k in keys], T.StructField("lag", T.LongType()),
        *[T.StructField(s, T.DoubleType()) for s in sums]])
    lags = np.arange(-max_lag, max_lag + 1)

    def correlate(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        side, g, v = table.column("_side").to_numpy(), table.column("_g").to_numpy(), numbers(table, "_v")
        rows, which, got = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if mid in (lo, hi):
                continue
            width = int(g[mid - 1] - g[lo]) + 1
            h0, span = g[lo] - max_lag, width + 2 * max_lag
            p, q = np.zeros((3, width)), np.zeros((3, span))    # present, value, square
            at = g[lo:mid] - g[lo]
            p[:, at] = np.stack([np.ones(len(at)), v[lo:mid], v[lo:mid] ** 2])
            ok = (g[mid:hi] >= h0) & (g[mid:hi] < h0 + span)
            at, y = (g[mid:hi] - h0)[ok], v[mid:hi][ok]
            q[:, at] = np.stack([np.ones(len(y)), y, y**2])
            size = 1 << int(np.ceil(np.log2(span + width)))
            fp, fq = np.conj(np.fft.rfft(p, size)), np.fft.rfft(q, size)
            # sum_g p[g] q[g + lag]
            s = np.fft.irfft(fp[[0, 1, 0, 1, 2, 0]] * fq[[0, 0, 1, 1, 0, 2]], size)[:, :2 * max_lag + 1]
            s[0] = np.rint(s[0])
            keep = s[0] > 0
            rows.append(np.full(int(keep.sum()), lo))
            which.append(lags[keep])
            got.append(s[:, keep])
        if not rows:
            return pa.table({f.name: table.column(f.name).slice(0, 0) if f.name in keys else pa.array(
                [], pa.int64() if f.name == "lag" else pa.float64()) for f in schema})
        found = table.select(keys).take(pa.array(np.concatenate(rows))).append_column("lag", pa.array(np.concatenate(which)))
        for name, x in zip(sums, np.concatenate(got, axis=1)):
            found = found.append_column(name, pa.array(x))
        return found

    # both sides of a block as one run of rows, the left one first
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    parts = each_group(both, [*keys, BLOCK], ["_side", "_g"], correlate, schema)
    total = parts.groupBy(*keys, "lag").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.col("_n")
    cov = F.col("_ab") - F.col("_a") * F.col("_b") / n
    va = F.greatest(F.col("_aa") - F.col("_a") * F.col("_a") / n, F.lit(0.0))
    vb = F.greatest(F.col("_bb") - F.col("_b") * F.col("_b") / n, F.lit(0.0))
    need = need if isinstance(need, Column) else F.lit(need)
    return total.select(
        *keys, "lag", n.cast("long").alias("points"),
        F.when(n >= need, cov / (F.sqrt(va) * F.sqrt(vb) + 1e-12)).alias("corr"))


def motion_signals(track: DataFrame, series: DataFrame, keys: Sequence[str], height: str = "height",
                   velocity: str = "vz", rate: float = SYNC_FS, smooth_rows: int = 9) -> tuple[DataFrame, DataFrame]:
    """Band-limited vertical velocity of both recordings on one common grid.

    The recording is resampled on its own grid, filtered, then read once on the
    track's grid phase, so every lag is a whole number of grid steps.
    """
    ok = F.col(height).isNotNull() & ~F.isnan(height)
    sm = smooth(track, keys, height, "_h", smooth_rows).filter(ok)
    dense = reblock(ordinal(sm.drop("n"), keys, "_o").withColumn("i", F.col("_o")).drop("_o", BLOCK))
    count = dense.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dense = lookup(dense, keys, count.withColumn("m", F.col("n"))).withColumnRenamed("m", "n")
    clip = uniform_grid(dense, keys, ["_h"], rate)
    clip = gradient(clip, keys, "_h", "_dv").withColumn("_fs", F.lit(rate))
    phase = clip.groupBy(*keys).agg(F.min("t").alias("_origin"))
    clip = zero_phase_band(clip, keys, "_dv", "signal", SYNC_LO, SYNC_HI, "_fs")
    log = uniform_grid(series, keys, [velocity], rate).withColumn("_fs", F.lit(rate))
    n = per_key(log, keys).join(phase, list(keys))
    log = zero_phase_band(log, keys, velocity, "_b", SYNC_LO, SYNC_HI, "_fs")
    # read several times by the second grid: written once
    log = settle(lookup(log, keys, n, "inner").select(*keys, "i", "n", BLOCK, "t", "_b", "_origin"))
    on_phase = uniform_grid(log, keys, ["_b"], rate, origin="_origin").withColumnRenamed("_b", "signal")
    return clip.select(*keys, "i", F.col("i").alias("k"), "n", BLOCK, "t", "signal"), on_phase


def lag_policy(curve: DataFrame, cadence: DataFrame, keys: Sequence[str], rate: float = SYNC_FS,
               start_s: float = MAX_LAG_S) -> DataFrame:
    """Accept or refuse the best lag of a wide sweep.

    ``curve``: keys, lag (grid steps), corr.  ``cadence``: keys, cadence_s and
    reach_s (the lag at which the records stop overlapping enough).  The search
    box starts at ``start_s`` and widens until the peak is a whole period
    inside; a widened peak must stay put; rivals must be whole periods away.
    """
    cadence = settle(cadence)
    c = settle(curve.filter("corr is not null").join(cadence, list(keys)))
    reach = F.greatest(F.col("reach_s"), F.lit(start_s))

    def box_of(k: Column) -> Column:
        """Half width of the k-th box: each WIDEN times the one before."""
        return F.lit(float(start_s)) * F.pow(F.lit(float(WIDEN)), k)

    def rung_of(half: Column) -> Column:
        """The first box that is as wide."""
        return F.greatest(F.lit(0), F.ceil(F.log(half / start_s) / float(np.log(WIDEN)))).cast("int")

    boxes = cadence.withColumn("_half", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), rung_of(reach) + 1), lambda k: F.least(box_of(k), reach))))).withColumn("_reach", reach)
    lag_s = F.col("lag") / rate
    # the smallest ladder box holding each lag
    size = box_of(rung_of(F.greatest(F.abs(lag_s) + 0.5 / rate, F.lit(start_s))))
    tiers = settle(c.withColumn("_tier", F.least(size, reach)).filter(F.abs(lag_s) <= reach).groupBy(*keys, "_tier").agg(
        F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.col("lag"))).alias("_p")))
    box = boxes.alias("b").join(tiers.alias("t"), list(keys)).filter("_tier <= _half").groupBy(
        *keys, "_half", "_reach", "cadence_s").agg(
        F.max_by("_p", F.struct("_p.corr", -F.col("_p.lag"))).alias("_p"))
    box = settle(box.withColumn("_at", F.col("_p.lag") / rate))
    inside = F.abs("_at") + F.col("cadence_s") <= F.col("_half")
    chosen = settle(box.filter(inside).groupBy(*keys).agg(
        F.min_by(F.struct("_half", "_reach", "_at", "_p", "cadence_s"), "_half").alias("_c")))
    wider = box.join(chosen, list(keys)).filter("_half > _c._half").groupBy(*keys).agg(
        F.min_by("_at", "_half").alias("_next_at"))
    picked = cadence.select(*keys, "cadence_s").join(chosen, list(keys), "left").join(wider, list(keys), "left")
    moved = (F.col("_c._half") > start_s) & (F.col("_c._half") < F.col("_c._reach")) & (
        F.abs(F.col("_next_at") - F.col("_c._at")) > STABLE_S)
    sweep = settle(c.join(chosen, list(keys)).filter(F.abs(lag_s) <= F.col("_c._half")))
    beside = sweep.select(*keys, F.col("lag").alias("_l"), F.col("corr").alias("_v"))
    near = sweep.join(beside.withColumn("lag", F.col("_l") + 1).select(*keys, "lag", F.col("_v").alias("_left")), [*keys, "lag"]).join(
        beside.withColumn("lag", F.col("_l") - 1).select(*keys, "lag", F.col("_v").alias("_right")), [*keys, "lag"])
    away = (F.col("lag") / rate - F.col("_c._at")) / F.col("_c.cadence_s")
    rivals = near.filter(
        (F.abs(F.col("lag") / rate - F.col("_c._at")) > RIVAL_GUARD_S) & (F.col("corr") >= F.col("_left"))
        & (F.col("corr") >= F.col("_right")) & (F.col("corr") >= RIVAL_FRACTION * F.col("_c._p.corr")))
    summary = rivals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rivals"),
        F.sum(F.when(F.abs(away - F.round(away)) > PERIOD_TOLERANCE, 1).otherwise(0)).alias("stray"))
    got = picked.join(summary, list(keys), "left").withColumn("stray", F.coalesce("stray", F.lit(0)))
    refusal = F.when(F.col("cadence_s").isNull() | (F.col("cadence_s") <= 0), "no_cadence").when(
        F.col("_c").isNull(), "at_boundary").when(moved, "unstable").when(F.col("stray") > 0, "stray_rival")
    return got.select(
        *keys, "cadence_s", F.col("_c._at").alias("offset"), F.col("_c._p.corr").alias("corr"),
        F.col("_c._half").alias("half_s"), F.coalesce("rivals", F.lit(0)).alias("rivals"), "stray",
        refusal.alias("refusal"))


def sidelobe_ratio(curve: DataFrame, keys: Sequence[str], rate: float, guard_s: float = RIVAL_GUARD_S) -> DataFrame:
    """Best local maximum outside the guard band over the peak."""
    peak = curve.groupBy(*keys).agg(F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.col("lag"))).alias("_p"))
    def shifted(step: int, name: str) -> DataFrame:
        return curve.select(*keys, (F.col("lag") + step).alias("lag"), F.col("corr").alias(name))

    near = curve.join(shifted(1, "_l"), [*keys, "lag"]).join(shifted(-1, "_r"), [*keys, "lag"]).join(peak, list(keys))
    far = near.filter(
        (F.abs(F.col("lag") - F.col("_p.lag")) / rate > guard_s) & (F.col("corr") >= F.col("_l"))
        & (F.col("corr") >= F.col("_r")))
    best = far.groupBy(*keys).agg(F.max("corr").alias("_far"))
    return peak.join(best, list(keys), "left").select(
        *keys, F.col("_p.lag").alias("lag"), F.col("_p.corr").alias("corr"),
        (F.col("_far") / F.col("_p.corr")).alias("sidelobe"))
