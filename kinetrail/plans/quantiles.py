"""Exact quantiles for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here groups of at most a block of rows are ranked as they are; in a larger
one a mergeable sketch first brackets the wanted rank, only values inside the
bracket are then ranked, and the number below it is a plain count.
The answer is exact (linear interpolation between order statistics) because
the sketch's rank error is bounded and the bracket is wider than that bound.

The values are written once before any of this: a mean computed again, its rows
added in another order, may differ in the last bit from the bracket it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.blocks import settle

ACCURACY = 100_000
SALTS = 64
WHOLE = 65_536   # rows of a group that is ranked without a sketch


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[Column | str, float]],
    accuracy: int = ACCURACY,
    whole: int = WHOLE,
) -> DataFrame:
    """One row per key with a column per entry of ``wanted``: name -> (value, q)."""
    names = list(wanted)
    entries = [
        F.struct(
            F.lit(name).alias("_name"), F.lit(float(q)).alias("_q"),
            (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v"),
        )
        for name, (v, q) in wanted.items()
    ]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
    long = settle(long.filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    group = [*keys, "_name"]
    found = _whole_groups(long, group, None)
    large = settle(long.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole).select(*group))
    # a null key meets no large group and stays with the small ones
    if not large.isEmpty():
        found = _whole_groups(long, group, large).unionByName(
            _bracketed(long.join(large, group, "left_semi"), group, sorted({float(q) for _, q in wanted.values()}), accuracy))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_val"))).alias(n) for n in names]
    )


def _value(a: Column, b: Column, rank: Column) -> Column:
    return a + (b - a) * (rank - F.floor(rank))


def _whole_groups(long: DataFrame, group: Sequence[str], without: DataFrame | None) -> DataFrame:
    """``_val`` of every group, or of those that are not in ``without``."""
    if without is not None:
        long = long.join(without, list(group), "left_anti")
    by_group = W.partitionBy(*group)
    rank = F.col("_q") * (F.col("_n") - 1)
    ranked = long.withColumns({
        "_r": F.row_number().over(by_group.orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(by_group)})
    return ranked.groupBy(*group).agg(
        F.max(F.when(F.col("_r") == F.floor(rank), F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_r") == F.ceil(rank), F.col("_v"))).alias("_b"), F.max(rank).alias("_rank"),
    ).select(*group, _value(F.col("_a"), F.col("_b"), F.col("_rank")).alias("_val"))


def _bracketed(long: DataFrame, group: Sequence[str], qs: Sequence[float], accuracy: int) -> DataFrame:
    """``_val`` of large groups, whose values many tasks share."""
    slack = 4.0 / accuracy
    # a rank is met for certain at the sketch's error plus two rows: the nearest
    # of a few fixed distances that is as far, up to the extremes of the group
    reaches = sorted({slack, *[r for r in (1e-3, 1e-2, 1e-1) if r > slack], 1.0})
    probes = sorted({min(max(q + s * r, 0.0), 1.0) for q in qs for r in reaches for s in (-1, 1)})
    at = {p: k for k, p in enumerate(probes)}
    need = F.lit(slack / 2) + F.lit(2.0) / F.col("_n")

    def probe(sign: float) -> Column:
        out = F.lit(None).cast("double")
        for q in qs:
            mine = F.lit(None).cast("double")
            for r in reversed(reaches):
                value = F.col("_sk")[at[min(max(q + sign * r, 0.0), 1.0)]]
                mine = value if r == 1.0 else F.when(need <= r, value).otherwise(mine)
            out = F.when(F.col("_q") == q, mine).otherwise(out)
        return out

    brackets = (
        long.groupBy(*group, "_q")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", probes, accuracy).alias("_sk"),
        )
        .select(
            *group, "_n",
            (F.col("_q") * (F.col("_n") - 1)).alias("_rank"),
            F.least(probe(-1.0), F.when(need > 0.1, F.col("_min"))).alias("_lo"),
            F.greatest(probe(1.0), F.when(need > 0.1, F.col("_max"))).alias("_hi"),
        )
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # equal values are merged first, so one value repeated often is one row
    counted = (
        long.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
        .join(brackets, [*group, "_salt"])
        .filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    )
    kept = counted.groupBy(*group, "_rank", "_v").agg(F.sum("_c").alias("_c"))
    w = W.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))
    ranked = kept.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))

    def holds(rank: Column) -> Column:
        return (F.col("_from") <= rank) & (rank < F.col("_upto"))

    low, high = F.floor("_rank"), F.ceil("_rank")
    picked = ranked.groupBy(*group).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_b"),
        F.max("_rank").alias("_rank"),
    ).withColumn(
        "_val", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile's bracket missed its rank")).cast("double"))
        .otherwise(_value(F.col("_a"), F.col("_b"), F.col("_rank")))
    )
    return picked.select(*group, "_val")


def exact_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column | str]) -> DataFrame:
    return exact_quantiles(df, keys, {name: (v, 0.5) for name, v in values.items()})
