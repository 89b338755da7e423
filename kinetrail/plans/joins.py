"""Range, as-of and tiled joins over blocked series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.blocks import BLOCK, block_rows, index_series, prefix, settle


def interval_join(
    series: DataFrame, intervals: DataFrame, keys: Sequence[str],
    start: str = "start_i", stop: str = "stop_i", how: str = "inner",
) -> DataFrame:
    """Samples x half-open position intervals ``[start, stop)`` of the same key.

    Intervals are laid over the blocks they touch, so the join is an equi-join
    on (key, block) with the range as residual and never a nested loop; the
    samples keep their (key, block) partitioning.
    """
    rows = block_rows(series.sparkSession)
    lo = F.floor(F.greatest(F.col(start), F.lit(0)) / rows).cast("long")
    hi = F.floor((F.col(stop) - 1) / rows).cast("long")
    spread = (
        intervals.filter(F.col(stop) > F.col(start))
        .withColumn(BLOCK, F.explode(F.sequence(lo, F.greatest(lo, hi))))
    )
    left, right = series.alias("s"), spread.alias("v")
    cond = (F.col("s.i") >= F.col(f"v.{start}")) & (F.col("s.i") < F.col(f"v.{stop}"))
    for c in [*keys, BLOCK]:
        cond = (F.col(f"s.{c}") == F.col(f"v.{c}")) & cond
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [c for c in spread.columns if c not in (*keys, BLOCK)]
    return joined.select("s.*", *[F.col(f"v.{c}") for c in extra])


def time_cells(df: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    """Explode rows over the time cells ``floor(t / width)`` they overlap."""
    a, b = F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")
    return df.withColumn("_cell", F.explode(F.sequence(a, F.greatest(a, b))))


def time_range_join(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], time: str,
    lo: str, hi: str, width: float, closed: str = "both", how: str = "inner", salts: int = 16,
) -> DataFrame:
    """Rows whose time lies in a window of the same key, by time cells.

    ``points`` are salted on their position so that a crowded cell is split;
    the (few) windows of the cell are repeated per salt.
    """
    p = points.withColumn("_cell", F.floor(F.col(time) / width).cast("long")).withColumn(
        "_salt", F.pmod(F.floor(F.col("i") / 64), F.lit(salts)).cast("int")
    ).alias("p")
    v = time_cells(windows, F.col(lo), F.col(hi), width).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ).alias("v")
    t, a, b = F.col(f"p.{time}"), F.col(f"v.{lo}"), F.col(f"v.{hi}")
    tests = {
        "both": (t >= a) & (t <= b), "left": (t >= a) & (t < b),
        "right": (t > a) & (t <= b), "neither": (t > a) & (t < b),
    }
    cond = tests[closed]
    for c in [*keys, "_cell", "_salt"]:
        cond = (F.col(f"p.{c}") == F.col(f"v.{c}")) & cond
    joined = p.join(v, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell", "_salt")
    mine = [c for c in points.columns]
    extra = [c for c in windows.columns if c not in keys and c not in mine]
    return joined.select(*[F.col(f"p.{c}") for c in mine], *[F.col(f"v.{c}") for c in extra])


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
    right_span: tuple[str, str], width: float,
) -> DataFrame:
    """Pairs of overlapping closed time spans of the same key, each pair once.

    Both sides are laid over time cells; a pair meeting in several cells is
    kept in the first one it shares.
    """
    (la, lb), (ra, rb) = left_span, right_span
    a = time_cells(left, F.col(la), F.col(lb), width).alias("a")
    b = time_cells(right, F.col(ra), F.col(rb), width).alias("b")
    cond = (F.col(f"a.{lb}") >= F.col(f"b.{ra}")) & (F.col(f"a.{la}") <= F.col(f"b.{rb}"))
    cond = cond & (F.col("a._cell") == F.greatest(
        F.floor(F.col(f"a.{la}") / width), F.floor(F.col(f"b.{ra}") / width)))
    for c in [*keys, "_cell"]:
        cond = (F.col(f"a.{c}") == F.col(f"b.{c}")) & cond
    extra = [c for c in right.columns if c not in keys and c not in left.columns]
    return a.join(b, cond).select(
        *[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in extra])


def salted_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], spread_by: Column, salts: int = 16,
    how: str = "inner",
) -> DataFrame:
    """Equi-join whose left side may hold a hot key: rows are spread over
    ``salts`` copies of the (small per key) right side."""
    left = rows.withColumn("_salt", F.pmod(spread_by, F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def bracket(
    queries: DataFrame, reference: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
) -> DataFrame:
    """Attach to each query row the reference rows just before and just after.

    Adds structs ``_prev`` (latest reference row at or before the query time)
    and ``_next`` (earliest at or after), each holding ``time`` and ``values``.
    Both inputs are merged into one indexed series and the neighbours are
    carried along it, so there is no key-less or per-pair join.
    """
    ref = reference.select(
        *keys, F.col(time), F.lit(0).alias("_side"),
        F.struct(F.col(time), *values).alias("_ref"),
        F.lit(None).cast(_payload(queries, keys, time)).alias("_row"),
    )
    rest = [c for c in queries.columns if c not in (*keys, time)]
    ask = queries.select(
        *keys, F.col(time).cast(reference.schema[time].dataType), F.lit(1).alias("_side"),
        F.lit(None).cast(ref.schema["_ref"].dataType).alias("_ref"),
        F.struct(*rest).alias("_row"),
    )
    merged = index_series(ref.unionByName(ask), keys, [time, "_side"])
    back = settle(prefix(merged, keys, {"_prev": ("last", "_ref")}))
    # a reference row at exactly the query time sorts before the query, so the
    # backward match covers it and serves as the forward match too
    both = prefix(back, keys, {"_ahead": ("last", "_ref")}, reverse=True)
    found = both.filter("_side = 1")
    exact = F.col(f"_prev.{time}") == F.col(time)
    return found.select(
        *keys, time, "_row.*", "_prev", F.when(exact, F.col("_prev")).otherwise(F.col("_ahead")).alias("_next")
    )


def _payload(df: DataFrame, keys: Sequence[str], time: str):
    from pyspark.sql import types as T

    return T.StructType([f for f in df.schema.fields if f.name not in (*keys, time)])


def interpolate(
    queries: DataFrame, reference: DataFrame, keys: Sequence[str], time: str,
    values: Sequence[str], outside: str = "clamp", fill: float = 0.0,
) -> DataFrame:
    """Linear interpolation of ``values`` at the query times.

    ``outside`` is ``clamp`` (end values), ``fill`` or ``null``.
    """
    got = bracket(queries, reference, keys, time, values)
    out = {}
    for v in values:
        a, b = F.col(f"_prev.{v}"), F.col(f"_next.{v}")
        ta, tb = F.col(f"_prev.{time}"), F.col(f"_next.{time}")
        frac = (F.col(time) - ta) / (tb - ta)
        inside = F.when(ta == tb, a).otherwise(a + (b - a) * frac)
        missing = F.col("_prev").isNull() | F.col("_next").isNull()
        edge = {
            "clamp": F.coalesce(a, b), "fill": F.lit(fill), "null": F.lit(None).cast("double"),
        }[outside]
        out[v] = F.when(missing, edge).otherwise(inside)
    return got.withColumns(out).drop("_prev", "_next")
