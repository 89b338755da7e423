"""Report tables over operator results: closure groups, bias variants, anchors, ranges.

Each table scans its input once: totals come from grouping sets, variants are
columns of one row per rep, and medians of all columns share one bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.blocks import BLOCK, settle
from kinetrail.plans.joins import interval_join
from kinetrail.plans.quantiles import exact_medians

PULL, IMPACT = "pull only", "impact inside"


def closure_groups(spans: DataFrame, kind: Column, split: Sequence[str], ident: Sequence[str], value: str = "dv",
                   duration: str = "duration_s", flag: str = "spans_impact", digits: int = 6) -> DataFrame:
    """Closures by kind, those of the kinds in ``split`` also by whether an event lies inside.

    Rows of a null kind are left out.  One row per (kind, part) with the medians and
    the identity of the interval nearest the median value (of equally near ones, to
    ``digits``, the first by ``ident``), one per kind (part null) and one for all.
    """
    part = F.when(~F.col("kind").isin(list(split)), "lifting").when(F.col(flag), IMPACT).otherwise(PULL)
    rows = settle(spans.withColumn("kind", kind).filter("kind is not null").withColumn("part", part).select(
        "kind", "part", *ident, value, duration))
    totals = rows.groupingSets([["kind", "part"], ["kind"], []], "kind", "part").agg(
        F.count(F.lit(1)).alias("intervals"), F.avg(value).alias("mean_dv"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms_dv"))
    # kinds and parts are names in the call: a few rows
    medians = settle(exact_medians(rows, ["kind", "part"], {"median_dv": value, "median_s": duration}))
    far = F.round(F.abs(F.col(value) - F.col("median_dv")), digits)
    shown = rows.join(F.broadcast(medians), ["kind", "part"]).groupBy("kind", "part").agg(
        F.min(F.struct(far.alias("_far"), *ident)).alias("shown"))
    return totals.join(medians, ["kind", "part"], "left").join(shown, ["kind", "part"], "left").select(
        "kind", "part", "intervals", "mean_dv", "rms_dv", "median_dv", "median_s",
        *[F.col(f"shown.{c}").alias(f"shown_{c}") for c in ident])


def bias_variants(series: DataFrame, reps: DataFrame, rests: DataFrame, keys: Sequence[str], accel: Sequence[str],
                  velocity: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Median horizontal drift of a key's reps under four corrections of a constant bias.

    ``series`` carries two axes of acceleration and their integrals.  A rep's own
    displacement is ``p1 - p0 - v0 T``, and a constant ``b`` takes ``b T^2 / 2`` off
    it, so no variant is integrated again.  Variants: ``none``; ``rep_mean`` (the
    rep's mean acceleration); ``closure`` (the constant that ends the rep at its
    first velocity); ``rest_mean`` (the mean over the intervals between neighbouring
    ``rests`` of their mean acceleration, zero without such an interval).
    """
    keys = list(keys)
    rows = series.select(*keys, "i", BLOCK, "t", *accel, *velocity, *position)
    state = F.struct("t", *velocity, *position)
    per_rep = interval_join(rows, reps.select(*keys, "rep", "start_i", "stop_i"), keys).groupBy(*keys, "rep").agg(
        F.min_by(state, "i").alias("a"), F.max_by(state, "i").alias("b"), *[F.avg(c).alias(f"m_{c}") for c in accel])
    segments = interval_join(rows.select(*keys, "i", BLOCK, *accel), rests.select(*keys, "start_i", "stop_i"), keys).groupBy(
        *keys, "start_i").agg(*[F.avg(c).alias(c) for c in accel])
    bias = segments.groupBy(*keys).agg(*[F.avg(c).alias(f"r_{c}") for c in accel])
    x = per_rep.join(bias, keys, "left").withColumn("T", F.col("b.t") - F.col("a.t"))
    half = F.col("T") * F.col("T") / 2

    def drift(offset) -> Column:
        parts = [F.col(f"b.{p}") - F.col(f"a.{p}") - F.col(f"a.{v}") * F.col("T") - offset(c, v) for c, v, p in zip(accel, velocity, position)]
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))

    variants = {
        "none": drift(lambda c, v: F.lit(0.0)),
        "rep_mean": drift(lambda c, v: F.col(f"m_{c}") * half),
        "closure": drift(lambda c, v: (F.col(f"b.{v}") - F.col(f"a.{v}")) * F.col("T") / 2),
        "rest_mean": drift(lambda c, v: F.coalesce(F.col(f"r_{c}"), F.lit(0.0)) * half),
    }
    wide = settle(x.select(*keys, "rep", *[c.alias(name) for name, c in variants.items()]))
    return exact_medians(wide, keys, {name: name for name in variants}).join(
        wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("reps_")), keys)


def two_anchors(holds: DataFrame, residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tilt at the opening and closing hold beside the median rep residual, which needs no hold.

    Keys without both holds keep their residual, keys without reps their tilts.
    """
    return holds.join(exact_medians(settle(residuals), keys, {"rep_residual": "residual"}), list(keys), "full")


def paired_ranges(ways: dict[str, DataFrame], keys: Sequence[str], base: str) -> DataFrame:
    """One row per key with the range each way gives, and how far each is from ``base``.

    ``ways`` maps a name to (keys, rom); a key missing in a way has null there.
    """
    keys = list(keys)
    parts = [df.select(*keys, F.lit(name).alias("way"), "rom") for name, df in ways.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionAll(p)
    wide = long.groupBy(*keys).pivot("way", list(ways)).agg(F.max("rom"))
    return wide.select(*keys, *ways, *[(F.col(w) - F.col(base)).alias(f"{w}_off") for w in ways if w != base])
