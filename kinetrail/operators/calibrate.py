"""Biases and attitude errors measured in still windows and holds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.functions import geometry as geo
from kinetrail.operators.motion import ACCEL, GYRO, QUAT, WORLD, magnitude
from kinetrail.operators.windows import frame_rows, hold_windows, stillest_window
from kinetrail.plans.blocks import BLOCK, lookup, per_key, windowed
from kinetrail.plans.joins import interval_join


def block_sem(rows: DataFrame, keys: Sequence[str], values: Sequence[str], position: str,
              block_s: float = 0.2) -> DataFrame:
    """Standard error from means of full blocks; infinite below two blocks.

    ``position`` counts rows inside the window; rows carry ``fs`` and ``len``.
    """
    size = frame_rows(block_s, 2)
    full = F.floor(F.col("len") / size)
    means = rows.withColumns({"_size": size, "_full": full}).withColumn(
        "_b", F.floor(F.col(position) / F.col("_size"))).filter(F.col("_b") < F.col("_full"))
    means = means.groupBy(*keys, "_b").agg(*[F.avg(v).alias(v) for v in values])
    few = F.count(F.lit(1)) < 2
    got = means.groupBy(*keys).agg(*[
        F.when(few, F.lit(float("inf"))).otherwise(F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias(f"sem_{v}")
        for v in values
    ])
    every = rows.select(*keys).distinct().join(got, list(keys), "left")
    return every.select(*keys, *[F.coalesce(f"sem_{v}", F.lit(float("inf"))).alias(f"sem_{v}") for v in values])


def gyro_bias(series: DataFrame, keys: Sequence[str], apply: bool = False,
              fallback: Sequence[float] | None = None, max_rate: float = 0.05, **window) -> DataFrame:
    """Rate bias in the stillest opening window: measured, and what to apply.

    Nothing is applied unless ``apply``; a ``fallback`` replaces windows that
    were not still.  Output per key: raw, residual, sem, snr, bias, flags.
    """
    still = stillest_window(series, keys, **window)
    inside = interval_join(series, still.drop("n"), keys).withColumns({
        "len": F.col("stop_i") - F.col("start_i"), "pos": F.col("i") - F.col("start_i")})
    raw = inside.groupBy(*keys).agg(*[F.avg(g).alias(f"raw_{g}") for g in GYRO])
    spread = geo.norm([F.col(g) - F.col(f"raw_{g}") for g in GYRO])
    # a still window is one second long, so the per-key table is small per row
    resid = lookup(inside, keys, raw.join(still.select(*keys, "n"), list(keys))).groupBy(*keys).agg(
        F.avg(spread).alias("residual"))
    sem = block_sem(inside, keys, GYRO, "pos")
    table = still.join(raw, list(keys), "left").join(resid, list(keys), "left").join(sem, list(keys), "left")
    confident = F.col("residual") < max_rate
    used = ~confident if fallback is not None else F.lit(False)
    out = {"confident": confident, "used_fallback": used}
    for k, g in enumerate(GYRO):
        base = F.col(f"raw_{g}") if apply else F.lit(0.0)
        out[f"bias_{g}"] = F.when(used, F.lit(float(fallback[k]))).otherwise(base) if fallback is not None else base
        s = F.col(f"sem_{g}")
        out[f"snr_{g}"] = F.abs(f"raw_{g}") / F.when(s > 0, s).otherwise(F.lit(float("inf")))
    return table.withColumns(out)


def window_mean(series: DataFrame, windows: DataFrame, keys: Sequence[str], values: Sequence[str],
                prefix: str = "mean_") -> DataFrame:
    """Mean of ``values`` inside one window per key (tilt, acceleration bias)."""
    return interval_join(series, windows.select(*keys, "start_i", "stop_i"), keys).groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.avg(v).alias(f"{prefix}{v}") for v in values])


def initial_tilt(series: DataFrame, keys: Sequence[str], **window) -> DataFrame:
    return window_mean(series, stillest_window(series, keys, **window), keys, ACCEL, "tilt_")


def accel_bias(series: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD, **window) -> DataFrame:
    return window_mean(series, stillest_window(series, keys, **window), keys, world, "bias_")


def remove_accel_bias(series: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD, **window) -> DataFrame:
    bias = accel_bias(series, keys, world, **window)
    return lookup(series, keys, bias).withColumns({
        w: F.col(w) - F.coalesce(F.col(f"bias_{w}"), F.lit(0.0)) for w in world
    }).drop(*[f"bias_{w}" for w in world])


def body_frame_bias(series: DataFrame, keys: Sequence[str], quat: Sequence[str] = QUAT,
                    world: Sequence[str] = WORLD, **window) -> DataFrame:
    """The pause's world bias turned into the sensor's own frame."""
    q = geo.inverse(geo.unit(geo.cols(*quat)))
    body = series.withColumns(dict(zip(("_bx", "_by", "_bz"), geo.rotate(q, geo.cols(*world)))))
    got = window_mean(body, stillest_window(series, keys, **window), keys, ("_bx", "_by", "_bz"), "")
    return got.withColumnsRenamed({"_bx": "body_x", "_by": "body_y", "_bz": "body_z"})


def hold_tilt(series: DataFrame, keys: Sequence[str], world: Sequence[str] = WORLD, span_s: float = 1.5) -> DataFrame:
    """Attitude error at the two holds from the leaked horizontal acceleration.

    One row per key having both holds: degrees open/close, their change, the
    horizontal vectors and the middle rows of the holds.
    """
    held = hold_windows(series, keys, span_s)
    mid = F.floor(F.col("len") / 2)
    per = held.groupBy(*keys, "hold").agg(
        F.avg(world[0]).alias("_x"), F.avg(world[1]).alias("_y"),
        F.max(F.when(F.col("rank") - F.col("start_k") == mid, F.struct("i", "t"))).alias("_mid"))
    lean = F.degrees(F.asin(F.least(F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2) / geo.G, F.lit(1.0))))

    def at(hold: str, c: Column) -> Column:
        return F.max(F.when(F.col("hold") == hold, c))

    pair = per.groupBy(*keys).agg(
        at("open", lean).alias("open_deg"), at("close", lean).alias("close_deg"),
        at("open", F.col("_x")).alias("open_x"), at("open", F.col("_y")).alias("open_y"),
        at("close", F.col("_x")).alias("close_x"), at("close", F.col("_y")).alias("close_y"),
        at("open", F.col("_mid.i")).alias("open_i"), at("close", F.col("_mid.i")).alias("close_i"),
        (at("close", F.col("_mid.t")) - at("open", F.col("_mid.t"))).alias("span_s"))
    return pair.filter("open_deg is not null and close_deg is not null").withColumn(
        "change_deg", F.col("close_deg") - F.col("open_deg"))


def gyro_only_drift(series: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle between the reported attitude at the closing anchor and the one
    integrated from rates alone since the opening anchor.

    The rate steps multiply in order; products of consecutive steps are taken
    inside blocks and the few block products are then multiplied in order
    (multiplication is associative).
    """
    keys = list(keys)
    span = anchors.select(*keys, F.col("open_i").alias("start_i"), F.col("close_i").alias("stop_i"))
    turn = geo.exponential(geo.scale(geo.cols(*GYRO), F.col("dt")))
    steps = interval_join(series, span, keys).select(
        *keys, BLOCK, "i", *[c.alias(n) for c, n in zip(turn, ("_w", "_x", "_y", "_z"))])
    schema = T.StructType([
        *[series.schema[k] for k in keys], T.StructField(BLOCK, T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("_w", "_x", "_y", "_z")],
    ])

    def product(order: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            q = pdf[["_w", "_x", "_y", "_z"]].to_numpy()
            while len(q) > 1:       # pairwise, keeping the order
                odd = q[-1:] if len(q) % 2 else None
                q = _multiply(q[0:len(q) - len(q) % 2:2], q[1::2])
                q = q if odd is None else np.vstack([q, odd])
            row = {k: pdf[k].iloc[0] for k in keys}
            return pd.DataFrame([{**row, BLOCK: pdf[BLOCK].iloc[0], **dict(zip(("_w", "_x", "_y", "_z"), q[0]))}])
        return run

    blocks = steps.groupBy(*keys, BLOCK).applyInPandas(product("i"), schema)
    total = blocks.groupBy(*keys).applyInPandas(product(BLOCK), schema).drop(BLOCK)
    ends = interval_join(series, anchors.select(*keys, F.explode(F.array(
        F.struct(F.lit("a").alias("_end"), F.col("open_i").alias("start_i"), (F.col("open_i") + 1).alias("stop_i")),
        F.struct(F.lit("b").alias("_end"), F.col("close_i").alias("start_i"), (F.col("close_i") + 1).alias("stop_i")),
    )).alias("_e")).select(*keys, "_e.*"), keys)
    pair = ends.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_end") == e, F.col(q))).alias(f"{e}_{q}") for e in ("a", "b") for q in QUAT])
    got = pair.join(total, keys, "left")
    start = geo.unit(geo.cols(*[f"a_{q}" for q in QUAT]))
    none = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    step = tuple(F.coalesce(F.col(c), d) for c, d in zip(("_w", "_x", "_y", "_z"), none))
    reached = geo.unit(geo.multiply(start, step))
    close = geo.unit(geo.cols(*[f"b_{q}" for q in QUAT]))
    off = geo.rotation_angle(geo.multiply(geo.inverse(reached), close))
    return got.select(*keys, F.degrees(off).alias("gyro_only_deg"))


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, v, x, u = a[:, :1], a[:, 1:], b[:, :1], b[:, 1:]
    return np.hstack([w * x - (v * u).sum(1, keepdims=True), w * u + x * v + np.cross(v, u)])


def mean_rotation(rows: DataFrame, keys: Sequence[str], quat: Sequence[str] = QUAT) -> DataFrame:
    """Mean rotation per group: dominant eigenvector of the summed outer products.

    The ten sums are plain aggregates; only that one small row meets Arrow.
    """
    keys = list(keys)
    q = geo.unit(geo.cols(*quat))
    pairs = [(a, b) for a in range(4) for b in range(a, 4)]
    sums = rows.groupBy(*keys).agg(*[F.sum(q[a] * q[b]).alias(f"_s{a}{b}") for a, b in pairs])
    names = ("mean_w", "mean_x", "mean_y", "mean_z")
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])

    def solve(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 4, 4))
            for a, b in pairs:
                m[:, a, b] = m[:, b, a] = pdf[f"_s{a}{b}"].to_numpy()
            v = np.linalg.eigh(m)[1][:, :, -1]
            v = v * np.where(v[:, :1] < 0, -1.0, 1.0)
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(v, columns=names)], axis=1)

    return sums.mapInPandas(solve, schema)


def split_bias(series: DataFrame, keys: Sequence[str], quat: Sequence[str] = QUAT,
               world: Sequence[str] = WORLD, span_s: float = 1.5) -> DataFrame:
    """Separate tilt leakage from body bias using the two holds' postures.

    The posture difference has rank two at most; below two the row has
    ``rank`` and null results.
    """
    keys = list(keys)
    held = hold_windows(series, keys, span_s)
    posture = mean_rotation(held, [*keys, "hold"], quat)
    leak = held.groupBy(*keys, "hold").agg(*[F.avg(w).alias(f"_r{k}") for k, w in enumerate(world)])
    table = posture.join(leak, [*keys, "hold"])
    cols = ["mean_w", "mean_x", "mean_y", "mean_z", "_r0", "_r1", "_r2"]
    wide = table.groupBy(*keys).agg(*[
        F.max(F.when(F.col("hold") == h, F.col(c))).alias(f"{h}{c}") for h in ("open", "close") for c in cols])
    wide = wide.filter("openmean_w is not null and closemean_w is not null")
    names = ("body_x", "body_y", "body_z", "tilt_x", "tilt_y", "tilt_z")
    schema = T.StructType([*[series.schema[k] for k in keys], T.StructField("rank", T.IntegerType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])

    def solve(batches):
        for pdf in batches:
            turn = {h: _matrices(pdf[[f"{h}{c}" for c in cols[:4]]].to_numpy()) for h in ("open", "close")}
            leak = {h: pdf[[f"{h}{c}" for c in cols[4:]]].to_numpy() for h in ("open", "close")}
            u, s, vt = np.linalg.svd(turn["open"] - turn["close"])
            live = s > 1e-8 * s[:, :1]
            inv = np.where(live, 1.0 / np.where(live, s, 1.0), 0.0)
            diff = leak["open"] - leak["close"]
            body = np.einsum("nji,nj->ni", vt, np.einsum("nji,nj->ni", u, diff) * inv)
            tilt = leak["open"] - np.einsum("nij,nj->ni", turn["open"], body)
            rank = live.sum(axis=1)
            both = np.where((rank >= 2)[:, None], np.hstack([body, tilt]), np.nan)
            out = pdf[keys].reset_index(drop=True).assign(rank=rank.astype("int32"))
            yield pd.concat([out, pd.DataFrame(both, columns=names)], axis=1)

    return wide.mapInPandas(solve, schema)


def _matrices(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    basis = np.eye(3)
    w, v = q[:, 0], q[:, 1:]
    cols = []
    for e in basis:
        c = np.cross(v, np.broadcast_to(e, v.shape))
        cols.append(e + 2 * w[:, None] * c + 2 * np.cross(v, c))
    return np.stack(cols, axis=2)


def fusion_split(series: DataFrame, keys: Sequence[str], quat: Sequence[str] = QUAT) -> DataFrame:
    """What the attitude filter added beyond the rates, per second, split into
    tilt (horizontal) and yaw (vertical) parts, in degrees."""
    def ahead(w):
        return {f"_n{c}": F.lead(c).over(w) for c in (*quat, *GYRO)}

    x = windowed(series, keys, ahead, after=1).filter(f"_n{quat[0]} is not null")
    now, nxt = geo.unit(geo.cols(*quat)), geo.unit(geo.cols(*[f"_n{c}" for c in quat]))
    mean_rate = tuple((F.col(g) + F.col(f"_n{g}")) * 0.5 for g in GYRO)
    rel = geo.multiply(geo.inverse(now), nxt)
    x = x.withColumns(dict(zip(("_rw", "_rx", "_ry", "_rz"), rel)))
    x = x.withColumns(dict(zip(("_ew", "_ex", "_ey", "_ez"), geo.exponential(geo.scale(mean_rate, F.col("dt"))))))
    extra = geo.unit(geo.multiply(geo.inverse(geo.cols("_ew", "_ex", "_ey", "_ez")), geo.cols("_rw", "_rx", "_ry", "_rz")))
    x = x.withColumns(dict(zip(("_iw", "_ix", "_iy", "_iz"), extra)))
    x = x.withColumns(dict(zip(("_lx", "_ly", "_lz"), geo.logarithm(geo.cols("_iw", "_ix", "_iy", "_iz")))))
    turned = geo.rotate(now, geo.cols("_lx", "_ly", "_lz"))
    x = x.withColumns(dict(zip(("_tx", "_ty", "_tz"), turned)))
    return x.withColumns({
        "tilt_rate": F.degrees(geo.norm(geo.cols("_tx", "_ty"))) / F.col("dt"),
        "yaw_rate": F.degrees(F.abs("_tz")) / F.col("dt"),
    }).drop(*[f"_{p}{c}" for p in "reilt" for c in "wxyz"], *[f"_n{c}" for c in (*quat, *GYRO)])
