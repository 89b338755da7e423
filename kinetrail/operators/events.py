"""Events: impacts, landings, rest instants, extrema with a refractory time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.operators.motion import ACCEL, GYRO, magnitude
from kinetrail.operators.windows import (
    AROUND, _scaled, frame_rows, local_maxima, rolling_mean, rolling_variance, wide_sums, widest,
    windowed_scaled,
)
from kinetrail.plans.blocks import BLOCK, block_rows, lookup, neighbours, per_key, settle, windowed
from kinetrail.plans.joins import time_range_join
from kinetrail.plans.quantiles import exact_medians
from kinetrail.plans.scans import refractory


def impacts(series: DataFrame, keys: Sequence[str], threshold_g: float = 6.0, gap_s: float = 1.5,
            skip_s: float = 5.0, value: Column | None = None) -> DataFrame:
    """First sample above the threshold, then quiet for ``gap_s`` after it."""
    mag = magnitude(ACCEL) / geo.G if value is None else value
    late = F.col("i") >= F.floor(F.lit(skip_s) * F.col("fs"))
    hot = series.withColumn("mag", mag).filter(late & (F.col("mag") > threshold_g))
    return refractory(hot.select(*keys, "i", "n", BLOCK, "t", "mag"), keys, "t", gap_s)


def landings(track: DataFrame, keys: Sequence[str], height: str = "height", floor_m: float = 0.05,
             gap_s: float = 1.5, skip_s: float = 10.0) -> DataFrame:
    """Debounced falls below ``floor_m``."""
    marked = windowed(track, keys, lambda w: {
        "_fall": (F.col(height) < floor_m) & ~F.coalesce(F.lag(height).over(w) < floor_m, F.lit(False))
        & F.lag("i").over(w).isNotNull()
    }, before=1)
    falls = marked.filter(F.col("_fall") & (F.col("t") > skip_s))
    return refractory(falls.select(*keys, "i", "n", BLOCK, "t"), keys, "t", gap_s)


def outer_extrema(track: DataFrame, keys: Sequence[str], value: str, third: float = 3.0,
                  gap_s: float = 0.8) -> DataFrame:
    """Turnarounds in the outer third of the travel: ``kind`` touch or lockout."""
    span = per_key(track, keys, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = lookup(track, keys, span)
    part = (F.col("_hi") - F.col("_lo")) / third
    low = local_maxima(x.withColumn("_neg", -F.col(value)), keys, "_neg", F.col(value) < F.col("_lo") + part)
    high = local_maxima(x, keys, value, F.col(value) > F.col("_hi") - part)
    cols = [*keys, "i", "n", BLOCK, "t", value]
    both = low.select(*cols, F.lit("touch").alias("kind")).unionByName(
        high.select(*cols, F.lit("lockout").alias("kind")))
    return refractory(both, [*keys, "kind"], "t", gap_s)


def rest_scores(series: DataFrame, keys: Sequence[str], window_s: float = 0.05, least: int = 3,
                accel: Column | None = None, gyro: Column | None = None) -> DataFrame:
    """Per row: normalised variance score and the mean magnitude around it."""
    rows = block_rows(series.sparkSession)
    a = magnitude(ACCEL) if accel is None else accel
    g = magnitude(GYRO) if gyro is None else gyro
    width = frame_rows(window_s, least)
    halo = widest(series, width)
    rolled = rolling_variance(series.withColumn("_mag", a), keys, {"_av": F.col("_mag"), "_gv": g}, width, halo)
    x = _scaled(rolled, width)

    def build(w):
        frame = W.partitionBy(*keys, BLOCK).orderBy("_u").rangeBetween(*AROUND)
        return {"mean_mag": F.avg("_mag").over(frame)}

    if halo > rows:
        around = wide_sums(x, keys, {"_total": F.col("_mag"), "_count": F.col("_mag").isNotNull().cast("double")},
                           F.col("i") - F.col("_w"), F.col("i") + F.col("_w") - 1)
        near = around.withColumn("mean_mag", F.when(F.col("_count") > 0, F.col("_total") / F.col("_count"))).drop("_total", "_count", "_w")
    else:
        near = windowed_scaled(x, keys, build, halo, halo, rows).drop("_w", "_u")
    near = settle(near)
    med = per_key(series, keys).join(
        exact_medians(near, keys, {"_ma": "_av", "_mg": "_gv"}), list(keys))
    scored = lookup(near, keys, med)
    score = F.col("_av") / (F.col("_ma") + 1e-12) + F.col("_gv") / (F.col("_mg") + 1e-12)
    return scored.withColumn("score", score).drop("_mag", "_av", "_gv", "_ma", "_mg")


def rest_instants(series: DataFrame, impact_rows: DataFrame, keys: Sequence[str], look_s: float = 1.0,
                  max_accel: float = 8.0, **kw) -> DataFrame:
    """Quietest row within ``look_s`` after each impact, unless still loaded."""
    scored = rest_scores(series, keys, **kw).select(*keys, "i", "n", BLOCK, "t", "score", "mean_mag")
    windows = impact_rows.select(
        *keys, F.col("i").alias("impact_i"), F.col("t").alias("_lo"), (F.col("t") + look_s).alias("_hi"))
    near = time_range_join(scored, windows, keys, "t", "_lo", "_hi", max(look_s, 1e-6), closed="left").filter(
        F.col("i") >= F.col("impact_i"))
    found = near.groupBy(*keys, "impact_i").agg(
        F.max("n").alias("n"),
        F.min_by(F.struct("i", "t", "mean_mag"), F.struct("score", "i")).alias("_r"))
    return found.filter(F.col("_r.mean_mag") <= max_accel).select(
        *keys, "impact_i", "n", F.col("_r.i").alias("i"), F.col("_r.t").alias("t"))


def impact_mask(series: DataFrame, impact_rows: DataFrame, keys: Sequence[str], half_s: float,
                out: str = "near_impact") -> DataFrame:
    """Rows within ``half_s`` of any impact, as a flag."""
    windows = impact_rows.select(
        *keys, (F.col("t") - half_s).alias("_lo"), (F.col("t") + half_s).alias("_hi"), F.col("t").alias("_c"))
    near = time_range_join(series.select(*keys, "i", "t"), windows, keys, "t", "_lo", "_hi", max(2 * half_s, 1e-6))
    hit = near.filter(F.abs(F.col("t") - F.col("_c")) <= half_s).select(*keys, "i").distinct()
    return series.join(hit.withColumn(out, F.lit(True)), [*keys, "i"], "left").withColumn(
        out, F.coalesce(out, F.lit(False)))


def gaps(rows: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Neighbouring events paired: adds ``prev_i, prev_t`` and ``gap``."""
    return neighbours(rows, keys, {"prev_i": "i", "prev_t": time}).withColumn(
        "gap", F.col(time) - F.col("prev_t"))
