"""Blocked series: the layout that lets one hot key span many tasks.

A *series* is a DataFrame with key columns plus

``i``     dense zero-based position of the row inside its key (long)
``n``     number of rows of the key (long)
``_blk``  ``i div block_rows``: the block the row lives in

Ordered work is done per (key, block), never per key, so a task holds at most
``block_rows`` rows (plus a halo) however skewed the keys are.  What must cross
block borders travels as one summary row per block:

* bounded frames (lag, rolling statistics) copy the few border rows into the
  neighbouring block (:func:`windowed`);
* running totals add the total of the earlier blocks (:func:`prefix`).

Both keep the (key, block) partitioning, so a chain of them costs one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from kinetrail.plans.stage import shared_dir

BLOCK = "_blk"
BLOCK_ROWS_CONF = "kinetrail.blockRows"
DEFAULT_BLOCK_ROWS = 65_536


def block_rows(spark: SparkSession) -> int:
    """Rows per block; fixed for a session because ``_blk`` depends on it."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Honour the cluster's ``spark.checkpoint.dir``; refuse a cluster without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result once (reliable checkpoint) and read it back.

    Used where a result feeds several branches: recomputing it per branch would
    grow with the depth of the plan.  Already settled frames pass through.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD":
        return df
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def block_of(df: DataFrame, position: Column | str) -> Column:
    """Block number of a position column."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(block_rows(df.sparkSession))).cast("long")


def reblock(df: DataFrame, position: Column | str = "i") -> DataFrame:
    """Attach ``_blk`` to rows that carry a position (events, lobes, runs)."""
    return df.withColumn(BLOCK, block_of(df, position))


def index_series(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Number the rows of every key in ``order``, without a task per key.

    Rows are range-partitioned on (keys, order), so a hot key is cut into many
    slices.  The slice boundaries come from sampling and must not be re-drawn,
    hence the checkpoint; after it only one small row per (key, slice) is
    needed to turn slice-local positions into global ones.
    """
    use_checkpoint_dir(df.sparkSession)
    cut = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_slice", F.shiftright("_pos", 33))
    )
    by_key = W.partitionBy(*keys)
    earlier = by_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        cut.groupBy(*keys, "_slice")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys, "_slice", "_first",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(by_key).alias("n"),
        )
    )
    # inner equi-join on the slice: a slice never exceeds one range partition
    out = (
        cut.join(slices, [*keys, "_slice"])
        .withColumn("i", F.col("_pos") - F.col("_first") + F.col("_before"))
        .drop("_pos", "_slice", "_first", "_before")
    )
    return reblock(out)


def block_window(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys, BLOCK).orderBy("i")


def windowed(
    series: DataFrame,
    keys: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Evaluate bounded-frame windows exactly, block by block.

    ``build`` receives the window (ordered by ``i``) and returns the new
    columns.  ``before``/``after`` bound how far, in rows, a frame may look;
    that many border rows are copied into the adjacent block and dropped again.
    """
    if not before and not after:
        return series.withColumns(build(block_window(keys)))
    rows = block_rows(series.sparkSession)
    first = F.greatest(F.floor((F.col("i") - after) / rows), F.lit(0))
    last = F.least(F.floor((F.col("i") + before) / rows), F.floor((F.col("n") - 1) / rows))
    copied = series.withColumn(BLOCK, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return copied.withColumns(build(block_window(keys))).filter(
        F.col(BLOCK) == block_of(series, "i")
    )


_KINDS = ("sum", "max", "min", "last", "count")


def prefix(
    rows: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[str, Column | str]],
    inclusive: bool = True,
    reverse: bool = False,
    order: Sequence[str] = ("i",),
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``count``/``last`` non-null over each key.

    Works on dense series and on sparse event rows alike: the frame is split
    into the part inside the row's block and a carry from the other blocks.
    ``reverse`` runs from the end of the key; ``inclusive=False`` leaves the
    row itself out (so ``last`` becomes "previous row" or, reversed, "next").
    """
    for out, (kind, _) in specs.items():
        if kind not in _KINDS:
            raise ValueError(f"unknown prefix kind {kind!r} for {out!r}")
    order_cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    blk_order = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order_cols).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    earlier = W.partitionBy(*keys).orderBy(blk_order).rowsBetween(W.unboundedPreceding, -1)

    staged = rows.withColumns({
        f"_in_{k}": (F.col(c) if isinstance(c, str) else c) for k, (_, c) in specs.items()
    })
    local, total, carry, merged = {}, [], [], {}
    pos = F.struct(*order)
    for out, (kind, _) in specs.items():
        src, loc, car = F.col(f"_in_{out}"), F.col(f"_loc_{out}"), F.col(f"_car_{out}")
        if kind in ("sum", "count"):
            fn = F.sum if kind == "sum" else F.count
            local[f"_loc_{out}"] = fn(src).over(inside)
            total.append(fn(src).alias(f"_tot_{out}"))
            carry.append(F.sum(f"_tot_{out}").over(earlier).alias(f"_car_{out}"))
            merged[out] = F.when(loc.isNull(), car).when(car.isNull(), loc).otherwise(loc + car)
            if kind == "count":
                merged[out] = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        elif kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            local[f"_loc_{out}"] = fn(src).over(inside)
            total.append(fn(src).alias(f"_tot_{out}"))
            carry.append(fn(f"_tot_{out}").over(earlier).alias(f"_car_{out}"))
            merged[out] = pick(loc, car)
        else:
            local[f"_loc_{out}"] = F.last(src, ignorenulls=True).over(inside)
            end = F.min_by if reverse else F.max_by
            total.append(end(src, F.when(src.isNotNull(), pos)).alias(f"_tot_{out}"))
            carry.append(F.last(f"_tot_{out}", ignorenulls=True).over(earlier).alias(f"_car_{out}"))
            merged[out] = F.coalesce(loc, car)

    carried = staged.groupBy(*keys, BLOCK).agg(*total).select(*keys, BLOCK, *carry)
    # keys that fit in one block carry nothing and drop out of the join side
    carried = carried.filter(reduce(or_, [F.col(f"_car_{o}").isNotNull() for o in specs]))
    scratch = [p + o for o in specs for p in ("_in_", "_loc_", "_car_")]
    return (
        staged.withColumns(local)
        .join(carried, [*keys, BLOCK], "left")
        .withColumns(merged)
        .drop(*scratch)
    )


def per_key(series: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-key aggregates that remember ``n``, so they can be looked up again."""
    return series.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def over_blocks(table: DataFrame) -> DataFrame:
    """One row per (key, block) from one row per key carrying ``n``."""
    rows = block_rows(table.sparkSession)
    top = F.floor((F.col("n") - 1) / rows).cast("long")
    return table.withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("long"), top)))


def lookup(series: DataFrame, keys: Sequence[str], table: DataFrame, how: str = "left") -> DataFrame:
    """Attach per-key values to series rows through (key, block).

    ``table`` has one row per key and carries ``n`` (see :func:`per_key`).
    The rows of a hot key stay spread over its blocks.
    """
    return series.join(over_blocks(table).drop("n"), [*keys, BLOCK], how)


def runs(
    series: DataFrame, keys: Sequence[str], mask: Column, aggs: Sequence[Column] = ()
) -> DataFrame:
    """Maximal runs of true: ``run, start_i, stop_i, len`` plus ``aggs``."""
    marked = windowed(
        series.withColumn("_on", F.coalesce(mask, F.lit(False))),
        keys,
        lambda w: {"_edge": F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))},
        before=1,
    )
    numbered = prefix(marked, keys, {"_run": ("sum", F.col("_edge").cast("long"))})
    found = (
        numbered.filter("_on")
        .groupBy(*keys, F.col("_run").alias("run"))
        .agg(
            F.min("i").alias("start_i"),
            (F.max("i") + 1).alias("stop_i"),
            F.count(F.lit(1)).alias("len"),
            *aggs,
        )
        .withColumn("run", F.col("run") - 1)
    )
    return found


def neighbours(
    rows: DataFrame, keys: Sequence[str], cols: dict[str, str], step: int = -1,
    order: Sequence[str] = ("i",),
) -> DataFrame:
    """Previous (``step=-1``) or next (``step=1``) row's columns, sparse-safe.

    ``cols`` maps new name -> source column.
    """
    packed = settle(rows).withColumn("_pack", F.struct(*[F.col(c).alias(n) for n, c in cols.items()]))
    got = prefix(
        packed, keys, {"_near": ("last", "_pack")}, inclusive=False, reverse=step > 0, order=order
    )
    return got.withColumns({n: F.col(f"_near.{n}") for n in cols}).drop("_pack", "_near")


def ordinal(rows: DataFrame, keys: Sequence[str], name: str = "k",
            order: Sequence[str] = ("i",)) -> DataFrame:
    """Zero-based rank of sparse rows inside their key."""
    return prefix(settle(rows), keys, {name: ("count", F.lit(1))}, inclusive=False, order=order)
