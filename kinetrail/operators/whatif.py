"""What would change under constant sensor errors: sweeps and attribution."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions import geometry as geo
from kinetrail.functions.rules import MODEL_LADDER, PLAUSIBLE, TERM_SIZE
from kinetrail.operators.calibrate import body_frame_bias, remove_accel_bias, split_bias
from kinetrail.operators.correct import cut, detrend
from kinetrail.operators.motion import (
    POSITION, QUAT, VELOCITY, WORLD, apply_offset, double_integral, error_model, error_models,
)
from kinetrail.plans.blocks import BLOCK, block_rows, lookup, per_key, settle
from kinetrail.plans.joins import salted_join


def best_overlap(spans: DataFrame, reps: DataFrame, keys: Sequence[str], span: tuple[str, str]) -> DataFrame:
    """For each ``[a, b]`` row span, the rep it overlaps most (first wins).

    Spans and reps meet over the blocks they touch, each pair once.
    """
    a, b = span
    rows = block_rows(spans.sparkSession)

    def laid(df, lo, hi):
        return df.withColumn("_cell", F.explode(F.sequence(
            F.floor(F.col(lo) / rows).cast("long"), F.floor(F.col(hi) / rows).cast("long"))))

    left = laid(spans, a, b)
    right = laid(reps.select(*keys, "rep", "start_i", "stop_i"), "start_i", "stop_i")
    amount = F.least(F.col(b), F.col("stop_i") - 1) - F.greatest(F.col(a), F.col("start_i"))
    got = left.join(right, [*keys, "_cell"]).withColumn("overlap", amount).filter(
        (F.col("overlap") > 0)
        & (F.col("_cell") == F.greatest(F.floor(F.col(a) / rows), F.floor(F.col("start_i") / rows))))
    return got.groupBy(*keys, *[c for c in spans.columns if c not in keys]).agg(
        F.max_by("rep", F.struct("overlap", -F.col("rep"))).alias("rep"),
        F.max("overlap").cast("double").alias("overlap"))


def parameter_grid(spark: SparkSession, axes: dict[str, Sequence[float]]) -> DataFrame:
    """All combinations of the listed values, numbered ``param_id`` (a fixed,
    small table that the caller writes down)."""
    names = list(axes)
    mesh = np.stack([m.ravel() for m in np.meshgrid(*[np.asarray(axes[n], float) for n in names], indexing="ij")], 1)
    rows = [(i, *map(float, r)) for i, r in enumerate(mesh)]
    return spark.createDataFrame(rows, "param_id int, " + ", ".join(f"{n} double" for n in names))


def with_params(series: DataFrame, grid: DataFrame) -> DataFrame:
    """Every series once per parameter row; ``param_id`` joins the key.

    The grid is a literal table, so its rows become an array that is exploded:
    no join, no shuffle.
    """
    rows = grid.collect()          # the caller's own short parameter table
    names = grid.columns
    items = F.array(*[F.struct(*[F.lit(r[n]).alias(n) for n in names]) for r in rows])
    return series.withColumn("_p", F.explode(items)).select(*series.columns, "_p.*")


def rebuild(series: DataFrame, keys: Sequence[str], params: dict[str, Sequence[str | float]],
            bias_frame: str | None = "world", lever: Sequence[str | float] | None = None,
            **window) -> DataFrame:
    """Acceleration to position again under perturbed input, same boundaries.

    ``bias_frame``: world, body, split (falls back to world where the holds do
    not differ) or None.  ``lever`` shifts the position.
    """
    keys = list(keys)
    x = error_model(series, {k: v for k, v in params.items() if k != "lever"})
    if bias_frame == "world":
        x = remove_accel_bias(x, keys, **window)
    elif bias_frame == "body":
        b = body_frame_bias(x, keys, **window)
        x = lookup(x, keys, b)
        turned = geo.rotate(geo.unit(geo.cols(*QUAT)), geo.cols("body_x", "body_y", "body_z"))
        x = x.withColumns({w: F.col(w) - F.coalesce(t, F.lit(0.0)) for w, t in zip(WORLD, turned)}).drop(
            "body_x", "body_y", "body_z")
    elif bias_frame == "split":
        parts = per_key(x, keys).join(split_bias(x, keys).filter("rank >= 2"), keys)
        flat = remove_accel_bias(x, keys, **window).select(*keys, "i", *[F.col(w).alias(f"_plain_{w}") for w in WORLD])
        x = lookup(x, keys, parts.drop("rank")).join(flat, [*keys, "i"])
        turned = geo.rotate(geo.unit(geo.cols(*QUAT)), geo.cols("body_x", "body_y", "body_z"))
        x = x.withColumns({
            w: F.coalesce(F.col(w) - (F.col(f"tilt_{a}") + t), F.col(f"_plain_{w}"))
            for w, a, t in zip(WORLD, "xyz", turned)
        }).drop(*[f"_plain_{w}" for w in WORLD], *[f"{p}_{a}" for p in ("body", "tilt") for a in "xyz"])
    x = double_integral(x, keys)
    both = [v for v in (lever, params.get("lever")) if v is not None]
    if both:
        total = [sum((F.col(v[k]) if isinstance(v[k], str) else F.lit(float(v[k])) for v in both), F.lit(0.0)) for k in range(3)]
        x = x.withColumns(dict(zip(("_ox", "_oy", "_oz"), total)))
        x = apply_offset(x, ("_ox", "_oy", "_oz")).drop("_ox", "_oy", "_oz")
    return x


def rebuild_each(series: DataFrame, keys: Sequence[str], candidates: Sequence[dict[str, Sequence[str | float]]],
                 carry: Sequence[str] = (), bias_frame: str | None = "world", **window) -> DataFrame:
    """The paths of :func:`rebuild` under every candidate side by side: ``px_k py_k pz_k`` for candidate ``k``.

    A sample is one row however many candidates there are, so what is shuffled
    and written grows by three numbers a candidate, not by a copy of the sample.
    Candidates are ``params`` of :func:`rebuild`; the bias frame is world or None.
    Returns the position columns ``i n _blk t``, ``carry`` and the paths, settled.
    """
    if bias_frame not in ("world", None):
        raise ValueError("side by side the bias frame is world or None")
    keys = list(keys)

    def named(stems: Sequence[str]) -> list[str]:
        return [f"{c}_{k}" for k in range(len(candidates)) for c in stems]

    x = error_models(series, candidates, [[f"{w}_{k}" for w in WORLD] for k in range(len(candidates))])
    if bias_frame == "world":
        x = remove_accel_bias(x, keys, named(WORLD), **window)
    x = double_integral(x, keys, named(WORLD), named(VELOCITY), named(POSITION))
    for k, params in enumerate(candidates):
        if "lever" in params:
            x = apply_offset(x, params["lever"], position=[f"{p}_{k}" for p in POSITION])
    return settle(x.select(*keys, "i", "n", BLOCK, "t", *carry, *named(POSITION)))


def grid_candidates(axes: dict[str, Sequence[float]], params: dict[str, Sequence[str | float]]) -> list[dict]:
    """``params`` with the values of every combination of ``axes``, in the order of :func:`parameter_grid`."""
    names = list(axes)
    return [{term: tuple(values[names.index(v)] if isinstance(v, str) else v for v in vector) for term, vector in params.items()}
            for values in product(*[axes[n] for n in names])]


def attribution(series: DataFrame, reps: DataFrame, keys: Sequence[str], bins: Column,
                world: Sequence[str] = WORLD) -> DataFrame:
    """Each bin's share of the detrended path: exact, because integration and
    detrending are linear.  ``bins`` labels every row; the label joins the key.
    """
    keys = list(keys)
    labels = series.select(*keys, "n", bins.alias("bin")).groupBy(*keys, "bin").agg(F.max("n").alias("n"))
    per = labels.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_set("bin").alias("_bins"))
    laid = lookup(series.withColumn("_own", bins), keys, per).withColumn("bin", F.explode("_bins"))
    masked = laid.withColumns({w: F.when(F.col("_own") == F.col("bin"), F.col(w)).otherwise(0.0) for w in world})
    masked = masked.drop("_own", "_bins")
    moved = double_integral(masked, [*keys, "bin"], world)
    spread = reps.select(*keys, "rep", "start_i", "stop_i").join(labels.select(*keys, "bin"), keys)
    return detrend(moved, spread, [*keys, "bin"])


def attribution_error(parts: DataFrame, whole: DataFrame, keys: Sequence[str],
                      position: Sequence[str] = POSITION) -> DataFrame:
    """Largest gap between the summed parts and the whole path."""
    total = parts.groupBy(*keys, "rep", "i").agg(*[F.sum(p).alias(f"_s_{p}") for p in position])
    diff = F.greatest(*[F.abs(F.col(f"_s_{p}") - F.col(p)) for p in position])
    return total.join(whole.select(*keys, "rep", "i", *position), [*keys, "rep", "i"]).groupBy(*keys).agg(
        F.max(diff).alias("worst"))


def best_params(scores: DataFrame, keys: Sequence[str], score: str = "h_rms") -> DataFrame:
    """Per key the parameter row with the lowest objective; null counts as inf."""
    s = F.coalesce(F.col(score), F.lit(float("inf")))
    return scores.groupBy(*keys).agg(
        F.min_by("param_id", F.struct(s, F.col("param_id"))).alias("param_id"), F.min(s).alias(score))


def transfer(scores: DataFrame, capture: str, score: str = "h_rms") -> DataFrame:
    """Leave-one-out: the parameter best for all *other* captures, and how it
    does on this one.  ``scores``: capture, param_id, score.

    The others' total is the grand total minus the own score, so no pair of
    captures is formed.
    """
    # an unusable pair has an infinite score: counted, not summed, so that it can be taken out again
    bad = (F.col(score) == F.lit(float("inf"))).cast("int")
    own = scores.withColumns({"_bad": bad, "_own": F.when(bad == 0, F.col(score)).otherwise(0.0)})
    total = own.groupBy("param_id").agg(F.sum("_own").alias("_all"), F.sum("_bad").alias("_all_bad"))
    others = salted_join(own, total, ["param_id"], F.xxhash64(capture)).withColumns(
        {"_rest": F.col("_all") - F.col("_own"), "_rest_bad": F.col("_all_bad") - F.col("_bad")})
    return others.groupBy(capture).agg(
        F.min_by(F.struct("param_id", score), F.struct("_rest_bad", "_rest", "param_id")).alias("_b"), F.min(score).alias("ceiling")
    ).select(capture, F.col("_b.param_id").alias("param_id"), F.col(f"_b.{score}").alias("transferred"), "ceiling")


def refine_grid(axes: dict[str, Sequence[float]], best: dict[str, float], shrink: float = 0.5) -> dict[str, list[float]]:
    """The same number of values per axis, around ``best``, over a smaller span."""
    out = {}
    for name, values in axes.items():
        half = (max(values) - min(values)) * shrink / 2
        out[name] = list(np.linspace(best[name] - half, best[name] + half, len(values)))
    return out


def plausibility(params: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Long form: term, magnitude, limit, factor, verdict.  Columns ``<term>_x/y/z``."""
    rows = [
        F.struct(F.lit(t).alias("term"), geo.norm(geo.cols(f"{t}_x", f"{t}_y", f"{t}_z")).alias("magnitude"),
                 F.lit(PLAUSIBLE[t]).alias("limit"))
        for t in terms]
    rest = [c for c in params.columns if c not in {f"{t}_{a}" for t in terms for a in "xyz"}]
    long = params.select(*rest, F.explode(F.array(*rows)).alias("_r")).select(*rest, "_r.*")
    return long.withColumns({
        "factor": F.col("magnitude") / F.col("limit"), "plausible": F.col("magnitude") <= F.col("limit")})


def unpack(params: DataFrame, theta: str, terms: Sequence[str]) -> DataFrame:
    """Flat parameter array to named columns, in the order of ``terms``."""
    out, at = {}, 0
    for t in terms:
        for k, a in zip(range(TERM_SIZE[t]), "xyz"):
            out[f"{t}_{a}"] = F.get(theta, F.lit(at + k))
        at += TERM_SIZE[t]
    return params.withColumns(out)


def model_ladder(spark: SparkSession) -> DataFrame:
    rows = [(k, "+".join(t) or "none", sum(TERM_SIZE[x] for x in t)) for k, t in enumerate(MODEL_LADDER)]
    return spark.createDataFrame(rows, "step int, terms string, n_params int")


def fibonacci_directions(spark: SparkSession, count: int = 60) -> DataFrame:
    """Evenly spread unit vectors, numbered ``param_id``."""
    k = np.arange(count) + 0.5
    phi, theta = np.arccos(1 - 2 * k / count), np.pi * (1 + 5**0.5) * k
    xyz = np.stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)], 1)
    return spark.createDataFrame(
        [(i, *map(float, v)) for i, v in enumerate(xyz)], "param_id int, dir_x double, dir_y double, dir_z double")


def lever_sweep(series: DataFrame, reps: DataFrame, keys: Sequence[str], directions: DataFrame,
                length: float = 0.14) -> DataFrame:
    """Per direction of the lever arm the median horizontal sweep over reps.

    Turning and detrending are linear, so samples carry the six horizontal parts of
    the three unit arms, and a direction is a sum of them: no sample is copied per
    direction, a rep is folded to its extremes in all directions at once.
    """
    from kinetrail.plans.quantiles import exact_medians

    keys, units = list(keys), {}
    for k, axis in enumerate("xyz"):
        arm = geo.rotate(geo.unit(geo.cols(*QUAT)), tuple(F.lit(length if j == k else 0.0) for j in range(3)))
        units |= {f"_x{axis}": arm[0], f"_y{axis}": arm[1]}
    x = series.select(*keys, "i", BLOCK, "t", *[c.alias(n) for n, c in units.items()])
    path = detrend(x, reps, keys, list(units), axes=range(len(units)), from_origin=False)
    ends, sweeps = [], []
    for row in directions.collect():          # the caller's own short parameter table
        px, py = (sum((F.col(f"_{h}{a}") * row[f"dir_{a}"] for a in "yz"), F.col(f"_{h}x") * row["dir_x"]) for h in "xy")
        size, p = px * px + py * py, row["param_id"]
        ends += [F.max(size).alias(f"_b{p}"), F.min(size).alias(f"_a{p}")]
        sweeps.append(F.struct(F.lit(p).alias("param_id"), (F.sqrt(f"_b{p}") - F.sqrt(f"_a{p}")).alias("sweep")))
    per = path.groupBy(*keys, "rep").agg(*ends).select(*keys, F.explode(F.array(*sweeps)).alias("_s")).select(*keys, "_s.*")
    return exact_medians(per, [*keys, "param_id"], {"sweep": "sweep"})
