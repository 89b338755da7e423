"""Peaks by distance and prominence, and repetitions read off a track alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.operators.windows import fill_gaps, rolling_mean
from kinetrail.plans.blocks import BLOCK, block_rows, lookup, ordinal, per_key, prefix, reblock, settle, windowed
from kinetrail.plans.joins import interval_join
from kinetrail.plans.quantiles import exact_medians


def _thin_block(h: np.ndarray, i: np.ndarray, own: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Highest first: 1 kept, -1 removed by a kept one, 0 open.

    Peaks from beside the block stay open, and so do those that an open higher
    peak may still remove.
    """
    state = np.full(len(h), -2)
    first, last = np.searchsorted(i, i - d, "right"), np.searchsorted(i, i + d, "left")
    for p in np.lexsort((i, h))[::-1]:
        if state[p] == -1:
            continue
        if own[p] and not (state[first[p]:last[p]] == 0).any():
            near = state[first[p]:last[p]]
            near[near != 1] = -1
            state[p] = 1
        else:
            state[p] = 0
    return state


def thin_by_distance(peaks: DataFrame, keys: Sequence[str], value: str, distance: Column | int) -> DataFrame:
    """Of peaks closer than ``distance`` rows the higher stays (later on ties).

    A block decides, highest first, all that the peaks beside it cannot change;
    what is left open goes round again.  A chain of peaks that decide each other
    takes a round per block it crosses, not per peak, and no key is gathered.
    """
    keys = list(keys)
    rows = block_rows(peaks.sparkSession)
    d = distance if isinstance(distance, Column) else F.lit(distance)
    open_, kept = settle(peaks.withColumn("_d", d.cast("long"))), None
    columns = open_.columns
    schema = T.StructType([*open_.schema.fields, T.StructField("_state", T.IntegerType())])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        own = pdf["_own"].to_numpy()
        state = _thin_block(pdf[value].to_numpy(float), pdf["i"].to_numpy(), own, pdf["_d"].to_numpy())
        tell = own & (state >= 0) | (state == -1)
        return pdf.assign(_state=state)[tell][[*columns, "_state"]]

    block = F.floor(F.col("i") / rows)
    while not open_.isEmpty():
        beside = F.sequence(F.floor((F.col("i") - F.col("_d")) / rows), F.floor((F.col("i") + F.col("_d")) / rows))
        dealt = open_.withColumn("_b", F.explode(beside)).withColumn("_own", F.col("_b") == block)
        told = settle(dealt.groupBy(*keys, "_b").applyInPandas(decide, schema))
        won = told.filter("_state = 1").drop("_state")
        gone = told.filter("_state = -1").select(*keys, "i").distinct()
        kept = won if kept is None else kept.unionByName(won)
        open_ = settle(told.filter("_state = 0").drop("_state").join(gone, [*keys, "i"], "left_anti"))
    return (open_ if kept is None else kept).drop("_d")


def _base(peaks: DataFrame, keys: list[str], side: int, count: int) -> DataFrame:
    """Lowest value on the way from each wanted peak to the first higher one on one
    side (``side`` -1 left, 1 right), by doubling over the peak sequence.

    ``peaks``: k, h, ``_wanted`` and ``v``, the valley between the peak and its
    neighbour on that side.
    """
    level = settle(peaks.select(*keys, "k", F.col("h").alias("_mx"), F.col("v").alias("_mn")))
    levels = [level]
    while (1 << len(levels)) < count:
        step = 1 << (len(levels) - 1)
        far = levels[-1].select(*keys, (F.col("k") - side * step).alias("k"), F.col("_mx").alias("_x2"), F.col("_mn").alias("_n2"))
        levels.append(settle(levels[-1].join(far, [*keys, "k"]).select(
            *keys, "k", F.greatest("_mx", "_x2").alias("_mx"), F.least("_mn", "_n2").alias("_mn"))))
    state = peaks.filter("_wanted").select(*keys, F.col("k").alias("_s"), (F.col("k") + side).alias("k"), "h", F.col("v").alias("_low"))
    for p in range(len(levels) - 1, -1, -1):
        step = levels[p].withColumnsRenamed({"_mx": "_x2", "_mn": "_n2"})
        pass_ = F.col("_x2").isNotNull() & (F.col("_x2") <= F.col("h"))
        state = state.join(step, [*keys, "k"], "left").select(
            *keys, "_s", F.when(pass_, F.col("k") + side * (1 << p)).otherwise(F.col("k")).alias("k"), "h",
            F.when(pass_, F.least("_low", "_n2")).otherwise(F.col("_low")).alias("_low"))
    return state.select(*keys, F.col("_s").alias("k"), F.col("_low").alias(f"_base{side}"))


def find_peaks(series: DataFrame, keys: Sequence[str], value: str, distance: Column | int = 1,
               padded: bool = False) -> DataFrame:
    """Strict local maxima thinned by ``distance``, with their prominence.

    The way to a base ends at the first higher row, which need not be a peak left by
    the thinning or a strict one: every row that no neighbour exceeds is a stop on it.
    ``padded`` treats the ends as falling away (so end rows can be peaks and
    the outer bases lie one range below the minimum).
    """
    keys = list(keys)
    x = settle(windowed(series, keys, lambda w: {
        "_l": F.lag(value).over(w), "_r": F.lead(value).over(w)}, before=1, after=1).withColumn("_y", F.col(value)))
    end = F.lit(padded)
    top = F.when(F.col("_l").isNull(), end).otherwise(F.col("_y") > F.col("_l")) & F.when(
        F.col("_r").isNull(), end).otherwise(F.col("_y") > F.col("_r"))
    carried = [*keys, "i", "n", BLOCK, "_y", *[c for c in ("t",) if c in series.columns]]
    found = thin_by_distance(x.filter(top).select(*carried), keys, "_y", distance)
    # flat tops count once, by their first row
    stop = (F.col("_l").isNull() | (F.col("_y") > F.col("_l"))) & (F.col("_r").isNull() | (F.col("_y") >= F.col("_r")))
    stops = x.filter(F.col("_y").isNotNull() & stop).select(*keys, "i", BLOCK, "_y").join(
        found.select(*keys, "i", F.lit(True).alias("_wanted")), [*keys, "i"], "left")
    stops = settle(ordinal(stops.withColumn("_wanted", F.coalesce("_wanted", F.lit(False))), keys, "k"))
    # valley before each stop, and the one after the last
    marked = x.join(stops.select(*keys, "i", F.lit(1).alias("_one")), [*keys, "i"], "left")
    slot = prefix(marked, keys, {"_slot": ("sum", F.coalesce("_one", F.lit(0)))}, inclusive=False)
    low = settle(slot.groupBy(*keys, F.coalesce("_slot", F.lit(0)).alias("k")).agg(F.min("_y").alias("v")))
    span = x.groupBy(*keys).agg((2 * F.min("_y") - F.max("_y")).alias("_pad"))
    count = stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    longest = count.agg(F.max("_count")).first()[0] or 0          # one number
    base = stops.select(*keys, "k", "_wanted", F.col("_y").alias("h")).join(count, keys).join(span, keys)
    pad = F.col("_pad") if padded else F.lit(float("inf"))
    left = base.join(low, [*keys, "k"]).withColumn("v", F.when(F.col("k") == 0, F.least("v", pad)).otherwise(F.col("v")))
    after = low.withColumn("k", F.col("k") - 1)
    right = base.join(after, [*keys, "k"], "left").withColumn("v", F.coalesce("v", F.col("h")))
    right = right.withColumn("v", F.when(F.col("k") == F.col("_count") - 1, F.least("v", pad)).otherwise(F.col("v")))
    a = _base(settle(left), keys, -1, longest)
    b = _base(settle(right), keys, 1, longest)
    at = stops.filter("_wanted").select(*keys, "i", "k")
    got = found.join(at.join(a, [*keys, "k"]).join(b, [*keys, "k"]).drop("k"), [*keys, "i"])
    return got.withColumn("prominence", F.col("_y") - F.greatest("_base-1", "_base1")).drop("_base-1", "_base1").withColumnRenamed("_y", "peak")


def track_reps(track: DataFrame, expected: DataFrame, keys: Sequence[str], fps: float, height: str = "height",
               least: float = 0.12, most: float = 0.60, steps: int = 40, default: float = 0.35) -> DataFrame:
    """Repetition windows from the track alone: between the extrema the series
    opens on, at the prominence whose count matches the label (else closest).

    ``expected``: keys, expected_reps (null: use ``default``).
    """
    keys = list(keys)
    win = max(3, int(round(0.15 * fps)) | 1)
    # as given: this smoothing pads with zeros, unlike the others
    sm = settle(rolling_mean(fill_gaps(track, keys, height, "_filled"), keys, "_filled", "_s", win, edge="zero"))
    edge = max(1, int(round(fps)))
    opens = exact_medians(sm.filter(F.col("i") < edge), keys, {"_open": "_s"})
    ends = per_key(sm, keys, F.min("_s").alias("_lo"), (F.max("_s") - F.min("_s")).alias("_span"))
    ends = ends.join(opens, keys).filter("_span > 0").withColumn(
        "_sign", F.when((F.col("_open") - F.col("_lo")) / F.col("_span") < 0.5, -1.0).otherwise(1.0))
    turned = lookup(sm, keys, ends.select(*keys, "n", "_sign"), "inner").withColumn("_y2", F.col("_s") * F.col("_sign"))
    peaks = find_peaks(turned.select(*keys, "i", "n", BLOCK, "_y2"), keys, "_y2", max(1, int(0.4 * fps)), padded=True)
    peaks = settle(peaks.join(ends.select(*keys, "_span"), keys).withColumn("_p", F.col("prominence") / F.col("_span")))
    grid = [float(g) for g in np.linspace(most, least, steps)]
    counts = peaks.withColumn("_z", F.explode(F.array(*[
        F.struct(F.lit(k).alias("s"), F.lit(g).alias("g")) for k, g in enumerate(grid)]))).filter(
        F.col("_p") >= F.col("_z.g")).groupBy(*keys, F.col("_z.s").alias("_step"), F.col("_z.g").alias("_g")).agg(
        (F.count(F.lit(1)) - 1).alias("_c"))
    best = counts.join(expected, keys).filter("expected_reps is not null").groupBy(*keys).agg(
        F.min_by("_g", F.struct(F.abs(F.col("_c") - F.col("expected_reps")), F.col("_step"))).alias("_cut"))
    cut = ends.select(*keys).join(best, keys, "left").withColumn("_cut", F.coalesce("_cut", F.lit(default)))
    chosen = peaks.join(cut, keys).filter(F.col("_p") >= F.col("_cut")).select(*keys, "i", BLOCK)
    from kinetrail.plans.blocks import neighbours

    pair = neighbours(chosen, keys, {"stop_i": "i"}, step=1).filter("stop_i is not null")
    return ordinal(pair, keys, "rep").select(*keys, "rep", F.col("i").alias("start_i"), "stop_i")


def own_range(track: DataFrame, keys: Sequence[str], height: str, prominence: float, distance: int) -> DataFrame:
    """Per trough of the track: the lower of its two shoulders less the trough."""
    keys = list(keys)
    t = settle(track.filter(F.col(height).isNotNull()).withColumn("_neg", -F.col(height)))
    dense = settle(reblock(ordinal(t.drop("n"), keys, "_o").withColumn("i", F.col("_o")).drop("_o", BLOCK)))
    n = dense.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    dense = settle(dense.join(n, keys).withColumnRenamed("_m", "n"))
    low = settle(find_peaks(dense.select(*keys, "i", "n", BLOCK, "_neg"), keys, "_neg", distance).filter(
        F.col("prominence") >= prominence).select(*keys, "i", "n", BLOCK, (-F.col("peak")).alias("trough")))
    from kinetrail.plans.blocks import neighbours

    both = neighbours(neighbours(low, keys, {"_a": "i"}), keys, {"_b": "i"}, step=1)
    both = ordinal(both, keys, "rep").withColumns({
        "_a": F.coalesce("_a", F.lit(0).cast("long")), "_b": F.coalesce("_b", F.col("n") - 1)})
    sides = both.select(*keys, "rep", "trough", F.col("i").alias("_k"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("_a").alias("start_i"), (F.col("i") + 1).alias("stop_i")),
        F.struct(F.lit(1).alias("side"), F.col("i").alias("start_i"), (F.col("_b") + 1).alias("stop_i")))).alias("_s"))
    sides = sides.select(*keys, "rep", "trough", "_k", "_s.*")
    tops = interval_join(dense.select(*keys, "i", BLOCK, height), sides, keys).groupBy(*keys, "rep", "trough", "side").agg(
        F.max(height).alias("_top"))
    return tops.groupBy(*keys, "rep", "trough").agg((F.min("_top") - F.max("trough")).alias("own_range"))
