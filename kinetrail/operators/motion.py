"""From raw readings to a world-frame path: spacing, attitude, integration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.functions.rules import dim_lift
from kinetrail.plans.blocks import BLOCK, lookup, per_key, prefix, windowed
from kinetrail.plans.quantiles import exact_medians

QUAT = ("qw", "qx", "qy", "qz")
ACCEL = ("ax", "ay", "az")
GYRO = ("gx", "gy", "gz")
WORLD = ("wx", "wy", "wz")
VELOCITY = ("vx", "vy", "vz")
POSITION = ("px", "py", "pz")


def spacing(series: DataFrame, keys: Sequence[str], time: str = "t", default: float = 0.01) -> DataFrame:
    """``dt``: time since the previous row; the first row borrows the second's."""
    def build(w):
        step = F.col(time) - F.lag(time).over(w)
        ahead = F.lead(time).over(w) - F.col(time)
        return {"dt": F.coalesce(step, ahead, F.lit(default))}

    return windowed(series, keys, build, before=1, after=1)


def sample_rate(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key ``n`` and ``fs`` = 1 / median spacing (first row not counted)."""
    base = per_key(series, keys)
    med = exact_medians(series.filter("i > 0").select(*keys, "dt"), keys, {"_m": "dt"})
    return base.join(med, list(keys), "left").select(
        *keys, "n", F.coalesce(1.0 / F.col("_m"), F.lit(100.0)).alias("fs")
    )


def with_rate(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup(series, keys, sample_rate(series, keys))


def magnitude(names: Sequence[str]) -> Column:
    return geo.norm(geo.cols(*names))


def correct_attitude(series: DataFrame, bias: Sequence[str | float], out: Sequence[str] = ("cw", "cx", "cy", "cz"),
                     time: str = "t") -> DataFrame:
    """Remove a constant body-rate bias: q * exp(b t)^-1."""
    b = tuple(F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in bias)
    turn = geo.exponential(geo.scale(b, F.col(time)))
    fixed = geo.multiply(geo.unit(geo.cols(*QUAT)), geo.inverse(turn))
    return series.withColumns(dict(zip(out, fixed)))


def to_world(series: DataFrame, corrected: Sequence[str] = QUAT, accel: Sequence[str] = ACCEL,
             out: Sequence[str] = WORLD) -> DataFrame:
    """Specific force to world acceleration through the corrected attitude."""
    reported = geo.unit(geo.cols(*QUAT))
    with_gravity = geo.sub(geo.cols(*accel), geo.rotate(geo.inverse(reported), geo.lit3(geo.GRAVITY)))
    world = geo.add(geo.rotate(geo.unit(geo.cols(*corrected)), with_gravity), geo.lit3(geo.GRAVITY))
    return series.withColumns(dict(zip(out, world)))


def double_integral(
    series: DataFrame, keys: Sequence[str], accel: Sequence[str] = WORLD,
    velocity: Sequence[str] = VELOCITY, position: Sequence[str] = POSITION, dt: str = "dt",
    kind: str = "double",
) -> DataFrame:
    """Acceleration -> velocity -> position by cumulative trapezoids, from rest.

    Inside a block both integrals start from zero; a block then contributes its
    velocity gain, its position gain and its duration, and the earlier blocks'
    contributions enter as ``v0`` and ``p0 + v0 * elapsed``.  ``kind`` may be a
    decimal type for exact integer input (the halves are then left out: the
    results are 2 x velocity and 4 x position).
    """
    exact = kind != "double"
    half = 1.0 if exact else 0.5

    def cast(c: Column) -> Column:
        return c.cast(kind)

    def edges(w):
        got = {f"_pa_{a}": F.lag(a).over(w) for a in accel}
        # the row that opens a block still integrates over its own step
        return got

    x = windowed(series, keys, edges, before=1)
    step = cast(F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col(dt)))
    x = x.withColumn("_h", step)

    def mul(a: Column, b: Column) -> Column:
        return cast(a * b) if exact else a * b

    x = x.withColumns({
        f"_dv_{v}": mul(cast(F.coalesce(F.col(f"_pa_{a}"), F.col(a))) + cast(F.col(a)), F.col("_h")) * (1 if exact else half)
        for a, v in zip(accel, velocity)
    })
    w = W.partitionBy(*keys, BLOCK).orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({f"_lv_{v}": cast(F.sum(f"_dv_{v}").over(upto)) for v in velocity})
    x = x.withColumns({
        f"_dp_{p}": mul(
            F.coalesce(F.lag(f"_lv_{v}").over(w), cast(F.lit(0))) + F.col(f"_lv_{v}"), F.col("_h")
        ) * (1 if exact else half)
        for v, p in zip(velocity, position)
    })
    x = x.withColumns({
        **{f"_lp_{p}": cast(F.sum(f"_dp_{p}").over(upto)) for p in position},
        "_el": cast(F.sum("_h").over(upto)),
    })
    blocks = x.groupBy(*keys, BLOCK).agg(
        cast(F.sum("_h")).alias("_T"),
        *[cast(F.sum(f"_dv_{v}")).alias(f"_V_{v}") for v in velocity],
        *[cast(F.sum(f"_dp_{p}")).alias(f"_P_{p}") for p in position],
    )
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    zero = cast(F.lit(0))
    blocks = blocks.withColumns({
        f"_v0_{v}": cast(F.coalesce(F.sum(f"_V_{v}").over(before), zero)) for v in velocity
    })
    double = 2 if exact else 1
    blocks = blocks.withColumns({
        f"_p0_{p}": cast(F.coalesce(
            F.sum(F.col(f"_P_{p}") + mul(F.col(f"_v0_{v}"), F.col("_T")) * double).over(before), zero))
        for v, p in zip(velocity, position)
    })
    carry = blocks.filter(F.col(BLOCK) > 0).select(
        *keys, BLOCK, *[f"_v0_{v}" for v in velocity], *[f"_p0_{p}" for p in position]
    )
    x = x.join(carry, [*keys, BLOCK], "left")
    final = {}
    for v, p in zip(velocity, position):
        v0 = F.coalesce(F.col(f"_v0_{v}"), zero)
        final[v] = cast(F.col(f"_lv_{v}") + v0)
        final[p] = cast(
            F.coalesce(F.col(f"_p0_{p}"), zero) + mul(v0, F.col("_el")) * double + F.col(f"_lp_{p}")
        )
    return x.withColumns(final).select(*series.columns, *velocity, *position)


def apply_offset(series: DataFrame, offset: Sequence[str | float], quat: Sequence[str] = QUAT,
                 position: Sequence[str] = POSITION, out: Sequence[str] | None = None) -> DataFrame:
    """p - R(t) d; a null offset leaves the position as it is."""
    d = tuple(F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in offset)
    arm = geo.rotate(geo.unit(geo.cols(*quat)), d)
    moved = [F.coalesce(F.col(p) - a, F.col(p)) for p, a in zip(position, arm)]
    return series.withColumns(dict(zip(out or position, moved)))


def wrist_offset(series: DataFrame, lift: str = "lift", **kw) -> DataFrame:
    """Shift by the offset measured for the row's lift; unknown lift: no shift."""
    dim = dim_lift(series.sparkSession).select(F.col("lift").alias(lift), "off_x", "off_y", "off_z")
    joined = series.join(F.broadcast(dim), lift, "left")  # three rows, fixed
    return apply_offset(joined, ("off_x", "off_y", "off_z"), **kw).drop("off_x", "off_y", "off_z")


def project(paths: DataFrame, axis: tuple[str, str] = ("axis_x", "axis_y"),
            position: Sequence[str] = POSITION) -> DataFrame:
    """(along-axis, vertical) coordinates; a zero axis is refused."""
    ax, ay = F.col(axis[0]), F.col(axis[1])
    size = F.sqrt(ax * ax + ay * ay)
    safe = F.when(size > 0, size).otherwise(
        F.raise_error(F.lit("axis is the zero vector")).cast("double")
    )
    return paths.withColumns({
        "u": (F.col(position[0]) * ax + F.col(position[1]) * ay) / safe,
        "h": F.col(position[2]),
    })


def error_model(series: DataFrame, params: dict[str, Sequence[str | float]],
                quat: Sequence[str] = QUAT, out: Sequence[str] = WORLD) -> DataFrame:
    """World acceleration under constant sensor errors: scale, bias, tilt, gravref."""
    def vec(name):
        return tuple(F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in params[name])

    a = geo.cols(*ACCEL)
    size = geo.norm(a)
    if "scale" in params:
        a = tuple(x * (1.0 + s) for x, s in zip(a, vec("scale")))
    if "bias" in params:
        a = geo.add(a, vec("bias"))
    turn = geo.exponential(vec("tilt")) if "tilt" in params else None
    if "gravref" in params:
        per_row = geo.exponential(geo.scale(vec("gravref"), size))
        turn = per_row if turn is None else geo.multiply(per_row, turn)
    q = geo.unit(geo.cols(*quat))
    staged = series.withColumns(dict(zip(("_ax", "_ay", "_az"), a)))
    q = geo.multiply(turn, q) if turn is not None else q
    staged = staged.withColumns(dict(zip(("_mw", "_mx", "_my", "_mz"), q)))
    got = to_world(staged, corrected=("_mw", "_mx", "_my", "_mz"), accel=("_ax", "_ay", "_az"), out=out)
    return got.drop("_ax", "_ay", "_az", "_mw", "_mx", "_my", "_mz")


def error_models(series: DataFrame, candidates: Sequence[dict[str, Sequence[str | float]]],
                 out: Sequence[Sequence[str]]) -> DataFrame:
    """:func:`error_model` under several candidates side by side, ``out[k]`` for candidate ``k``.

    What no candidate changes (attitude, gravity in the sensor's frame) is worked
    out once a row, in columns that the candidates share.
    """
    q, g = ("_mw", "_mx", "_my", "_mz"), ("_gx", "_gy", "_gz")
    x = series.withColumns(dict(zip(q, geo.unit(geo.cols(*QUAT)))))
    x = x.withColumns({**dict(zip(g, geo.rotate(geo.inverse(geo.cols(*q)), geo.lit3(geo.GRAVITY)))),
                       **dict(zip(("_uw", "_ux", "_uy", "_uz"), geo.unit(geo.cols(*q)))), "_size": geo.norm(geo.cols(*ACCEL))})
    worlds = {}
    for params, names in zip(candidates, out):
        def vec(name):
            return tuple(F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in params[name])

        a = geo.cols(*ACCEL)
        if "scale" in params:
            a = tuple(v * (1.0 + s) for v, s in zip(a, vec("scale")))
        if "bias" in params:
            a = geo.add(a, vec("bias"))
        turn = geo.exponential(vec("tilt")) if "tilt" in params else None
        if "gravref" in params:
            per_row = geo.exponential(geo.scale(vec("gravref"), F.col("_size")))
            turn = per_row if turn is None else geo.multiply(per_row, turn)
        facing = geo.cols("_uw", "_ux", "_uy", "_uz")
        if turn is not None:
            facing = geo.unit(geo.multiply(turn, geo.cols(*q)))
        worlds |= dict(zip(names, geo.add(geo.rotate(facing, geo.sub(a, geo.cols(*g))), geo.lit3(geo.GRAVITY))))
    return x.withColumns(worlds).drop(*q, *g, "_uw", "_ux", "_uy", "_uz", "_size")


def unwrap(series: DataFrame, keys: Sequence[str], angle: str, out: str = "unwrapped") -> DataFrame:
    """Continuous angle: first value plus the sum of wrapped differences."""
    stepped = windowed(
        series, keys,
        lambda w: {"_d": F.coalesce(geo.wrap_angle(F.col(angle) - F.lag(angle).over(w)), F.col(angle))},
        before=1,
    )
    return prefix(stepped, keys, {out: ("sum", "_d")}).drop("_d")
