"""Data-quality checks: flags and a long findings table, never dropped rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.functions.rules import dim_lift, rom_flag
from kinetrail.operators.motion import ACCEL, GYRO, QUAT, magnitude
from kinetrail.plans.blocks import lookup, per_key, reblock, runs
from kinetrail.plans.joins import interval_join


def irregular_sampling(series: DataFrame, keys: Sequence[str], limit: float = 0.15) -> DataFrame:
    cv = F.stddev_pop("dt") / F.avg("dt")
    return series.filter("i > 0").groupBy(*keys).agg(cv.alias("dt_cv")).withColumn(
        "irregular", F.col("dt_cv") > limit)


def quaternion_norm(series: DataFrame, keys: Sequence[str], limit: float = 1e-3) -> DataFrame:
    off = F.max(F.abs(geo.norm(geo.cols(*QUAT)) - 1.0))
    return series.groupBy(*keys).agg(off.alias("norm_error")).withColumn(
        "not_unit", F.col("norm_error") > limit)


def clipped_samples(series: DataFrame, keys: Sequence[str], axes: Sequence[str] = ACCEL,
                    min_run: int = 2) -> DataFrame:
    """Samples sitting in runs of >= ``min_run`` at an axis' own max or min.

    A constant axis is counted at both extremes.
    """
    extremes = per_key(series, keys, *[
        fn(a).alias(f"_{kind}_{a}") for a in axes for kind, fn in (("max", F.max), ("min", F.min))
    ])
    flagged = lookup(series, keys, extremes)
    kinds = [(a, kind) for a in axes for kind in ("max", "min")]
    long = flagged.select(
        *keys, "i", "n", "_blk",
        F.explode(F.array(*[
            F.struct(F.lit(f"{kind}_{a}").alias("rail"), (F.col(a) == F.col(f"_{kind}_{a}")).alias("_at"))
            for a, kind in kinds
        ])).alias("_r"),
    ).select(*keys, "i", "n", "_blk", "_r.rail", "_r._at")
    found = runs(long, [*keys, "rail"], F.col("_at"))
    counted = found.filter(F.col("len") >= min_run).groupBy(*keys).agg(F.sum("len").alias("_c"))
    return extremes.select(*keys).join(counted, list(keys), "left").select(
        *keys, F.coalesce("_c", F.lit(0)).alias("clipped"))


def closing_hold(series: DataFrame, keys: Sequence[str], min_hold_s: float = 2.0,
                 max_rate: float = 0.05, min_log_s: float = 5.0) -> DataFrame:
    """Closing hold by phase where the channel exists, else the last seconds' rate.

    ``series`` carries ``fs``.  ``held_s`` is null without a phase channel.
    """
    base = per_key(
        series, keys, F.max("t").alias("_end"), F.max("fs").alias("_fs"),
        F.count("phase").alias("_phased"),
        F.sum(F.when(F.col("phase") == 2, 1).otherwise(0)).alias("_closing"),
    )
    late = lookup(series, keys, base.select(*keys, "n", "_end")).filter(
        F.col("t") > F.col("_end") - min_hold_s)
    rate = late.groupBy(*keys).agg(F.avg(magnitude(GYRO)).alias("_rate"))
    whole = F.col("_phased") == F.col("n")
    held = F.when(whole, F.col("_closing") / F.greatest("_fs", F.lit(1.0)))
    tail = F.when(~whole & (F.col("n") > 1) & (F.col("_end") > min_log_s), F.col("_rate"))
    return base.join(rate, list(keys), "left").select(
        *keys, held.alias("held_s"), tail.alias("tail_rate"),
        F.coalesce(held < min_hold_s, tail > max_rate, F.lit(False)).alias("no_hold"),
    )


def brief_transients(series: DataFrame, keys: Sequence[str], threshold_g: float = 8.0,
                     min_ms: float = 50.0) -> DataFrame:
    """Runs above ``threshold_g`` too short for the sample rate, and the peak."""
    mag = magnitude(ACCEL) / geo.G
    peak = series.groupBy(*keys).agg(F.max(mag).alias("peak_g"), F.max("fs").alias("_fs"))
    found = runs(series, keys, mag > threshold_g)
    short = F.col("len") < F.greatest(F.lit(min_ms) * F.col("_fs") / 1000.0, F.lit(2.0))
    return (
        peak.join(found, list(keys), "left")
        .groupBy(*keys).agg(
            F.sum(F.when(short, 1).otherwise(0)).alias("brief"), F.max("peak_g").alias("peak_g"))
    )


def findings(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The whole battery in long form: keys, rule, severity, value."""
    def rows(df: DataFrame, rule: str, test: Column, value: str) -> DataFrame:
        return df.filter(test).select(
            *keys, F.lit(rule).alias("rule"), F.lit("warning").alias("severity"),
            F.col(value).cast("double").alias("value"))

    hold = closing_hold(series, keys)
    parts = [
        rows(irregular_sampling(series, keys), "irregular_sampling", F.col("irregular"), "dt_cv"),
        rows(quaternion_norm(series, keys), "quaternion_norm", F.col("not_unit"), "norm_error"),
        rows(clipped_samples(series, keys), "clipped", F.col("clipped") > 0, "clipped"),
        rows(hold.withColumn("v", F.coalesce("held_s", "tail_rate")), "no_closing_hold", F.col("no_hold"), "v"),
        rows(brief_transients(series, keys), "brief_transients", F.col("brief") > 0, "brief"),
    ]
    return reduce(DataFrame.unionByName, parts)


def rep_clipping(series: DataFrame, reps: DataFrame, keys: Sequence[str],
                 axes: Sequence[str] = ACCEL) -> DataFrame:
    """Clipping judged inside every rep window on its own extremes."""
    bounds = reps.select(*keys, "rep", "start_i", "stop_i")
    cut = interval_join(series.select(*keys, "i", "_blk", *axes), bounds, keys)
    # the rep becomes part of the key and positions restart inside it
    local = reblock(cut.withColumns({
        "n": F.col("stop_i") - F.col("start_i"), "i": F.col("i") - F.col("start_i"),
    }).drop("start_i", "stop_i"))
    counted = clipped_samples(local, [*keys, "rep"], axes)
    return bounds.select(*keys, "rep").join(counted, [*keys, "rep"], "left").select(
        *keys, "rep", F.coalesce("clipped", F.lit(0)).alias("clipped"),
        (F.coalesce("clipped", F.lit(0)) == 0).alias("ok"))


def rom_flags(reps: DataFrame, rom: str = "rom", lift: str = "lift") -> DataFrame:
    """Vertical range against the lift's band, both sides; unknown lift: null."""
    dim = dim_lift(reps.sparkSession).select(F.col("lift").alias(lift), "rom_lo", "rom_hi")
    return reps.join(F.broadcast(dim), lift, "left").withColumn(
        "rom_flag", rom_flag(F.col(rom), F.col("rom_lo"), F.col("rom_hi"))
    ).drop("rom_lo", "rom_hi")


def fore_aft_flags(reps: DataFrame, coefficient: str = "c", lift: str = "lift") -> DataFrame:
    """Fore-aft coefficient above the lift's bound; lifts without one are refused."""
    dim = dim_lift(reps.sparkSession).select(F.col("lift").alias(lift), "fore_aft_max")
    size = F.abs(F.col(coefficient))
    return reps.join(F.broadcast(dim), lift, "left").withColumn(
        "fore_aft_flag",
        F.when(F.col("fore_aft_max").isNull(), "refused").when(size > F.col("fore_aft_max"), "above"),
    ).withColumn("fore_aft_factor", size / F.col("fore_aft_max")).drop("fore_aft_max")


def rep_count_check(captures: DataFrame, reps: DataFrame, keys: Sequence[str],
                    expected: str = "expected_reps") -> DataFrame:
    found = reps.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return captures.join(found, list(keys), "left").withColumn(
        "found", F.coalesce("found", F.lit(0))
    ).withColumn("mismatch", F.col(expected).isNotNull() & (F.col(expected) != F.col("found")))
