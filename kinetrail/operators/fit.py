"""Objective, search and ceilings of rebuilt paths."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.correct import detrend
from kinetrail.operators.whatif import rebuild, rebuild_each
from kinetrail.plans.blocks import BLOCK, lookup, per_key, reblock, settle
from kinetrail.plans.joins import interpolate, salted_join
from kinetrail.plans.quantiles import exact_medians

REFEREE = "ref_x"
INF = float("inf")


def with_referee(series: DataFrame, track: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """The series with the referee's horizontal place at each row's time, null outside the track's span.

    It does not depend on any parameter, so it is interpolated once and carried
    through every rebuild.  Only positions and times take part in that; the
    other columns of the series meet the result once.
    """
    ref = track.filter(F.col(x).isNotNull()).select(*keys, "t", F.col(x).alias(REFEREE))
    at = interpolate(series.select(*keys, "i", "t"), ref, keys, "t", [REFEREE], outside="null").select(*keys, "i", REFEREE)
    own = reblock(series)
    return own.join(reblock(at), [*keys, BLOCK, "i"]).select(*own.columns, REFEREE)


def rep_moments(rebuilt: DataFrame, reps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of moment sums per rep of detrended path and referee, both from the rep's first row.

    A rep is ``covered`` if the referee is known at all its rows.  All that the
    objective needs follows from these sums: rows are read once.
    """
    path = detrend(rebuilt, reps, keys, ("px", "py", REFEREE), axes=(0, 1))
    x, y, r = F.col("px"), F.col("py"), F.col(REFEREE)
    sums = {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "r": r, "rr": r * r, "xr": x * r, "yr": y * r}
    return path.groupBy(*keys, "rep").agg(
        F.count(F.lit(1)).alias("m"), (F.count(r) == F.count(F.lit(1))).alias("covered"),
        *[F.sum(v).alias(f"s_{k}") for k, v in sums.items()])


def each_moments(paths: DataFrame, reps: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """The rows of :func:`rep_moments` with ``param_id``, from ``count`` paths side by side
    (:func:`~kinetrail.operators.whatif.rebuild_each`) and reps that all of them share."""
    flat = [f"{p}_{k}" for k in range(count) for p in ("px", "py")]
    path = detrend(paths.select(*keys, "i", "n", BLOCK, "t", REFEREE, *flat), reps, keys, (*flat, REFEREE), axes=range(len(flat)))
    r, sums = F.col(REFEREE), {}
    for k in range(count):
        x, y = F.col(f"px_{k}"), F.col(f"py_{k}")
        sums |= {f"x_{k}": x, f"y_{k}": y, f"xx_{k}": x * x, f"yy_{k}": y * y, f"xy_{k}": x * y, f"xr_{k}": x * r, f"yr_{k}": y * r}
    per = path.groupBy(*keys, "rep").agg(
        F.count(F.lit(1)).alias("m"), (F.count(r) == F.count(F.lit(1))).alias("covered"),
        F.sum(r).alias("s_r"), F.sum(r * r).alias("s_rr"), *[F.sum(v).alias(f"s_{n}") for n, v in sums.items()])
    own = [F.struct(F.lit(k).alias("param_id"), *[F.col(f"s_{c}_{k}").alias(f"s_{c}") for c in ("x", "y", "xx", "yy", "xy", "xr", "yr")])
           for k in range(count)]
    return per.select(*keys, "rep", "m", "covered", "s_r", "s_rr", F.explode(F.array(*own)).alias("_o")).select(
        *keys, "rep", "m", "covered", "s_r", "s_rr", "_o.*")


def objective(rebuilt: DataFrame, reps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_compared, h_rms, null_h_rms): median over the covered reps of the horizontal rms in centimetres.

    ``rebuilt`` carries the referee (:func:`with_referee`); ``reps`` the same
    keys.  The path is projected on the key's principal axis, with one sign for
    all reps of a key.  A key that cannot be scored has an infinite ``h_rms``;
    one without any rep is absent.
    """
    return score_moments(rep_moments(rebuilt, reps, list(keys)), keys)


def score_moments(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`objective` from the rows of :func:`rep_moments`."""
    keys = list(keys)
    m = settle(moments)
    total = m.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("m", "s_x", "s_y", "s_xx", "s_yy", "s_xy")])
    n, x, y = F.col("m"), F.col("s_x"), F.col("s_y")
    turn = 0.5 * F.atan2(2.0 * (F.col("s_xy") - x * y / n), (F.col("s_xx") - x * x / n) - (F.col("s_yy") - y * y / n))
    axis = total.select(*keys, F.cos(turn).alias("_c"), F.sin(turn).alias("_s"))
    c, s = F.col("_c"), F.col("_s")
    on_axis = salted_join(m.filter("covered"), axis, keys, F.col("rep")).select(
        *keys, "rep", "m", "s_r", "s_rr", (c * F.col("s_x") + s * F.col("s_y")).alias("s_p"),
        (c * c * F.col("s_xx") + 2.0 * c * s * F.col("s_xy") + s * s * F.col("s_yy")).alias("s_pp"),
        (c * F.col("s_xr") + s * F.col("s_yr")).alias("s_pr"))
    sign = on_axis.groupBy(*keys).agg(
        F.when(F.sum(F.col("s_pr") - F.col("s_p") * F.col("s_r") / F.col("m")) < 0, -1.0).otherwise(1.0).alias("_sign"),
        F.count(F.lit(1)).alias("n_compared"))
    per = salted_join(on_axis, sign, keys, F.col("rep"))
    gap = F.col("s_pp") - 2.0 * F.col("_sign") * F.col("s_pr") + F.col("s_rr")
    med = exact_medians(per, keys, {
        "h_rms": F.sqrt(F.greatest(gap, F.lit(0.0)) / F.col("m")) * 100, "null_h_rms": F.sqrt(F.col("s_rr") / F.col("m")) * 100})
    return axis.select(*keys).join(sign.drop("_sign"), keys, "left").join(med, keys, "left").select(
        *keys, F.coalesce("n_compared", F.lit(0)).alias("n_compared"),
        F.coalesce(F.when(~F.isnan("h_rms"), F.col("h_rms")), F.lit(INF)).alias("h_rms"), "null_h_rms")


def each_candidate(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], spread_by: Column | None = None) -> DataFrame:
    """Every row once per candidate of its key; ``candidates`` has (keys, n, grid array of structs with ``param_id``).

    Series rows find their key's array through its blocks; others (``spread_by``) through a salted join.
    """
    if spread_by is None:
        laid = lookup(rows, keys, candidates.select(*keys, "n", F.col("grid").alias("_g")), "inner")
    else:
        laid = salted_join(rows, candidates.select(*keys, F.col("grid").alias("_g")), keys, spread_by)
    return laid.withColumn("_g", F.explode("_g")).select(*rows.columns, "_g.*")


def bracket_search(series: DataFrame, reps: DataFrame, keys: Sequence[str], axes: dict[str, tuple[float, float]],
                   params: dict[str, Sequence[str | float]], rounds: int = 3, points: int = 3, shrink: float = 0.5,
                   **how) -> DataFrame:
    """Per key the parameters with the least objective, by rounds of ever smaller brackets of its own.

    ``axes``: column -> (centre, half width) of the first bracket; ``params`` says
    where :func:`~kinetrail.operators.whatif.rebuild` uses the columns, ``how`` is
    passed to it.  A round scores ``points`` values an axis, so
    ``points ** len(axes)`` paths a key, all keys at once, and centres the next
    bracket on the best; ``points`` must be odd, so that the best is scored again
    and no round is worse than the one before.  What passes from round to round is one
    row a key.  ``series`` carries the referee.

    Returns (keys, n_compared, the axes' columns, start_h_rms, h_rms, null_h_rms, beats_null).
    """
    if points % 2 == 0:
        raise ValueError("points must be odd")
    keys, names = list(keys), list(axes)
    steps = list(product(*[np.linspace(-1.0, 1.0, points).tolist()] * len(names)))
    middle = len(steps) // 2
    state = per_key(series, keys).withColumns({a: F.lit(float(c)) for a, (c, _) in axes.items()})
    start = None
    for k in range(rounds):
        grid = F.array(*[F.struct(F.lit(p).alias("param_id"), *[
            (F.col(a) + o * axes[a][1] * shrink**k).alias(a) for a, o in zip(names, step)]) for p, step in enumerate(steps)])
        asked = settle(state.select(*keys, "n", grid.alias("grid")))
        each = [*keys, "param_id"]
        spans = reps.select(*keys, "rep", "start_i", "stop_i")
        if how.get("bias_frame", "world") in ("world", None):
            value = {(a, p): F.col("_g")[p][a].alias(f"{a}_{p}") for p in range(len(steps)) for a in names}
            laid = lookup(series, keys, asked.select(*keys, "n", F.col("grid").alias("_g")), "inner").select(*series.columns, *value.values())
            own = [{term: tuple(f"{v}_{p}" if v in names else v for v in vector) for term, vector in params.items()} for p in range(len(steps))]
            moments = each_moments(rebuild_each(laid, keys, own, [REFEREE], **how), spans, keys, len(steps))
        else:
            moments = rep_moments(rebuild(each_candidate(series, asked, keys), each, params, **how),
                                  each_candidate(spans, asked, keys, F.col("rep")).drop(*names), each)
        scores = settle(score_moments(moments, each))
        best = scores.groupBy(*keys).agg(
            F.min_by(F.struct("param_id", "n_compared", "h_rms", "null_h_rms"), F.struct(
                "h_rms", F.abs(F.col("param_id") - middle), "param_id")).alias("_b"),
            F.max(F.when(F.col("param_id") == middle, F.col("h_rms"))).alias("_first"))
        first = F.col("_first") if start is None else F.col("start_h_rms")
        state = asked.join(best, keys) if start is None else asked.join(best, keys).join(state.select(*keys, "start_h_rms"), keys)
        start = True
        state = settle(state.withColumn("_p", F.element_at("grid", F.col("_b.param_id") + 1)).select(
            *keys, "n", F.col("_b.n_compared").alias("n_compared"), *[F.col(f"_p.{a}").alias(a) for a in names],
            first.alias("start_h_rms"), F.col("_b.h_rms").alias("h_rms"), F.col("_b.null_h_rms").alias("null_h_rms")))
    return state.drop("n").withColumn("beats_null", F.col("null_h_rms") / F.col("h_rms"))


AXES = {"horizontal": "u", "vertical": "h"}


def ceiling(curves: DataFrame, keys: Sequence[str], order: int = 2) -> DataFrame:
    """What no detrend of a family can beat, per rep and axis, beside what the path reached: centimetres rms.

    ``curves`` are those of :func:`~kinetrail.operators.score.against_track`.
    ``shipped`` is the corrected path's distance from the referee, ``null`` the
    referee's own size, ``order_k`` what the best polynomial of that order in the
    rep's own time leaves of the *uncorrected* path's error.  The models are nested, so
    one matrix of moments a rep serves all: each order adds one column to its
    triangular factor.  A rep too short, or without duration, for a column gains nothing by it.
    """
    keys = list(keys)
    u = F.when(F.col("duration") > 0, F.col("tau") / F.col("duration")).otherwise(0.0)
    rows = curves.select(*keys, "rep", u.alias("_u"), F.explode(F.array(*[F.struct(
        F.lit(name).alias("axis"), (F.col(f"raw_{s}") - F.col(f"ref_{s}")).alias("e"),
        (F.col(f"pipe_{s}") - F.col(f"ref_{s}")).alias("p"), F.col(f"ref_{s}").alias("r")) for name, s in AXES.items()])).alias("_a")).select(
        *keys, "rep", "_u", "_a.*")
    power = [F.lit(1.0)]
    for _ in range(2 * order):
        power.append(power[-1] * F.col("_u"))
    m = rows.groupBy(*keys, "rep", "axis").agg(
        *[F.sum(x).alias(f"_s{k}") for k, x in enumerate(power)], *[F.sum(F.col("e") * power[k]).alias(f"_m{k}") for k in range(order + 1)],
        F.sum(F.col("e") ** 2).alias("_ee"), F.sum(F.col("p") ** 2).alias("_pp"), F.sum(F.col("r") ** 2).alias("_rr"))
    n = F.col("_s0")
    out = {"shipped": F.sqrt(F.col("_pp") / n) * 100, "null": F.sqrt(F.col("_rr") / n) * 100}
    # row k of the factor: its products with the columns before, its pivot, its share of the error
    left = F.col("_ee")
    for k in range(order + 1):
        entry = {}
        for j in range(k):
            have = F.col(f"_s{j + k}")
            for i in range(j):
                have = have - F.col(f"_l{j}_{i}") * entry[i]
            entry[j] = F.when(F.col(f"_l{j}_{j}") > 0, have / F.col(f"_l{j}_{j}")).otherwise(0.0)
        pivot, share = F.col(f"_s{2 * k}"), F.col(f"_m{k}")
        for j in range(k):
            pivot, share = pivot - entry[j] * entry[j], share - entry[j] * F.col(f"_y{j}")
        m = m.withColumns({f"_l{k}_{j}": e for j, e in entry.items()}).withColumn(
            f"_l{k}_{k}", F.when(pivot > 1e-12 * F.col(f"_s{2 * k}"), F.sqrt(pivot)).otherwise(0.0))
        m = m.withColumn(f"_y{k}", F.when(F.col(f"_l{k}_{k}") > 0, share / F.col(f"_l{k}_{k}")).otherwise(0.0))
        left = left - F.col(f"_y{k}") * F.col(f"_y{k}")
        out[f"order_{k}"] = F.sqrt(F.greatest(left, F.lit(0.0)) / n) * 100
    return m.select(*keys, "rep", "axis", *[v.alias(k) for k, v in out.items()])


def ceiling_table(per_rep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians over the reps, the ``headroom`` of the best line over what was reached, and the ``gain`` of the square term."""
    med = exact_medians(per_rep, [*keys, "axis"], {c: c for c in ("shipped", "order_1", "order_2", "null")})
    return med.withColumns({"headroom": F.col("shipped") - F.col("order_1"), "gain": F.col("order_1") - F.col("order_2")})
