"""Referee tracks and the detections they come from (points, never pixels)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.functions import geometry as geo
from kinetrail.functions.rules import STICKER_RATIO
from kinetrail.operators.motion import unwrap
from kinetrail.plans.blocks import BLOCK, index_series, lookup, ordinal, per_key, prefix, reblock, settle
from kinetrail.plans.quantiles import exact_medians, exact_quantiles
from kinetrail.functions.rules import rom_flag
from kinetrail.plans.scans import refractory

FRAME = ("clip_id", "f")
CLIP = ("clip_id",)
WHOLE_FRAME = 64   # points of a frame whose triples are formed in its row


# ---------------------------------------------------------------- detections --
def strongest(dets: DataFrame, k: int | None = 200, ident: str = "event_id") -> DataFrame:
    """The ``k`` strongest points of every frame, ranked (``r`` from 0); all if ``k`` is None."""
    w = W.partitionBy(*FRAME).orderBy(F.desc("strength"), ident)
    ranked = dets.withColumn("r", F.row_number().over(w) - 1)
    return ranked if k is None else ranked.filter(F.col("r") < k)


def static_points(dets: DataFrame, n_sample: int | None = None, cell: float = 3.0, recur: float = 0.7) -> DataFrame:
    """Grid cells hit in more than ``recur`` of a clip's frames, as centroids; of about
    ``n_sample`` evenly spaced frames, if given."""
    sampled = dets
    if n_sample is not None:
        last = dets.groupBy(*CLIP).agg((F.max("f") + 1).alias("_frames"))
        stride = F.greatest(F.lit(1), F.floor(F.col("_frames") / n_sample))
        # one number per clip
        sampled = dets.join(last, list(CLIP)).filter(F.col("f") % stride == 0)
    cells = sampled.groupBy(
        *CLIP, F.bround(F.col("y") / cell).cast("long").alias("cy"), F.bround(F.col("x") / cell).cast("long").alias("cx"), "f"
    ).agg(F.count(F.lit(1)).alias("_c"), F.sum("y").alias("_y"), F.sum("x").alias("_x"))
    seen = cells.groupBy(*CLIP, "cy", "cx").agg(
        F.count(F.lit(1)).alias("_seen"), F.sum("_c").alias("_c"), F.sum("_y").alias("_y"), F.sum("_x").alias("_x"))
    frames = sampled.groupBy(*CLIP).agg(F.countDistinct("f").alias("_of"))
    return seen.join(frames, list(CLIP)).filter(F.col("_seen") / F.col("_of") > recur).select(
        *CLIP, "cy", "cx", (F.col("_y") / F.col("_c")).alias("y"), (F.col("_x") / F.col("_c")).alias("x"))


def suppress(dets: DataFrame, fixed: DataFrame, radius: float = 3.0) -> DataFrame:
    """Drop points closer than ``radius`` to a fixed one, by neighbouring cells."""
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / radius).cast("long")

    reach = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = fixed.select(*CLIP, F.col("y").alias("_y"), F.col("x").alias("_x"), cell("y").alias("_r"), cell("x").alias("_c"), reach.alias("_n"))
    around = around.select(*CLIP, "_y", "_x", (F.col("_r") + F.col("_n.a")).alias("_cy"), (F.col("_c") + F.col("_n.b")).alias("_cx"))
    d, s = dets.withColumns({"_cy": cell("y"), "_cx": cell("x")}).alias("d"), around.alias("s")
    cond = (F.col("d.clip_id") == F.col("s.clip_id")) & (F.col("d._cy") == F.col("s._cy")) & (F.col("d._cx") == F.col("s._cx"))
    near = F.hypot(F.col("d.y") - F.col("s._y"), F.col("d.x") - F.col("s._x")) < radius
    return d.join(s, cond & near, "left_anti").drop("_cy", "_cx")


def merge_close_points(dets: DataFrame, merge_px: float = 3.0) -> DataFrame:
    """Of points closer than ``merge_px`` keep the stronger, strongest first.

    Chosen in rounds over cells so small that points of one cell exclude each other:
    only a cell's strongest open point can be kept, and it is kept if no stronger
    open point of the cells around lies within ``merge_px``; then open points near a
    kept one go.  A point meets at most one candidate a cell, so a frame of very many
    points is spread over its cells.  The joins are by sort: sizes are guessed from the
    compressed file, so a small one's laid-out cells would be gathered in the driver to
    be broadcast.  Rounds follow the longest chain of neighbours
    of falling strength.  Points without finite coordinates are near to nothing and stay.
    """
    top = settle(strongest(dets, None).select(*FRAME, "r", "y", "x", "event_id", "strength"))
    if merge_px <= 0:
        same = W.partitionBy(*FRAME, "y", "x").orderBy("r")
        first = (F.row_number().over(same) == 1) | ~_placed() if merge_px == 0 else F.lit(True)
        return top.withColumn("_first", first).filter("_first").drop("_first")
    side = 0.7 * merge_px
    open_points = top.filter(_placed()).select(*FRAME, "r", "y", "x", _cell("y", side).alias("_row"), _cell("x", side).alias("_col"))
    kept = [top.filter(~_placed()).select(*FRAME, "r")]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)]))
    at = [*FRAME, "_row", "_col"]
    near = F.hypot(F.col("y") - F.col("_y"), F.col("x") - F.col("_x")) <= merge_px

    def around(points: DataFrame) -> DataFrame:
        laid = points.withColumn("_s", steps)
        return laid.select(*FRAME, F.col("r").alias("_r"), F.col("y").alias("_y"), F.col("x").alias("_x"),
                           (F.col("_row") + F.col("_s.a")).alias("_row"), (F.col("_col") + F.col("_s.b")).alias("_col"))

    while not open_points.isEmpty():
        best = settle(open_points.groupBy(*at).agg(F.min_by(F.struct("r", "y", "x"), "r").alias("_b")).select(*at, "_b.*"))
        beaten = open_points.join(around(best).hint("merge"), at).filter(near & (F.col("r") < F.col("_r"))).select(
            *FRAME, F.col("_r").alias("r")).distinct()
        chosen = settle(best.join(beaten.hint("merge"), [*FRAME, "r"], "left_anti"))
        kept.append(chosen.select(*FRAME, "r"))
        if len(kept) > 16:
            kept = [settle(reduce(DataFrame.unionByName, kept))]
        o, c = open_points.alias("o"), around(chosen).alias("c").hint("merge")
        same_cell = reduce(and_, [F.col(f"o.{k}") == F.col(f"c.{k}") for k in at])
        open_points = settle(o.join(c, same_cell & near, "left_anti"))
    return top.join(reduce(DataFrame.unionByName, kept).hint("merge"), [*FRAME, "r"], "left_semi")


def _placed() -> Column:
    """Both coordinates are finite numbers."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("y", "x")]
    return finite[0] & finite[1]


def _cell(c: str, reach: float) -> Column:
    return F.floor(F.col(c) / reach).cast("long")


def near_points(left: DataFrame, y: str, x: str, points: DataFrame, tag: str, reach: float) -> DataFrame:
    """Every row of ``left`` with the points of its frame in the nine cells around (``y``, ``x``).

    Cells are ``reach`` wide, so no point within ``reach`` is left out, and a frame
    of very many points is joined cell by cell.  The points' columns get ``tag`` behind
    their names.
    """
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    laid = left.withColumn("_n", around).withColumns({
        "_row": _cell(y, reach) + F.col("_n.a"), "_col": _cell(x, reach) + F.col("_n.b")}).drop("_n")
    named = points.select(*FRAME, _cell("y", reach).alias("_row"), _cell("x", reach).alias("_col"),
                          *[F.col(c).alias(f"{c}{tag}") for c in points.columns if c not in FRAME])
    return laid.join(named, [*FRAME, "_row", "_col"]).drop("_row", "_col")


def _near_triples(p: DataFrame, shortest: float, longest: float, all_sides: bool) -> DataFrame:
    """Triples ra < rb < rc of a frame's points whose sides from the first (or all sides) lie in the given bounds."""
    def side(a: str, b: str) -> Column:
        return F.hypot(F.col(f"y{a}") - F.col(f"y{b}"), F.col(f"x{a}") - F.col(f"x{b}"))

    first = p.select(*FRAME, *[F.col(c).alias(f"{c}a") for c in p.columns if c not in FRAME])
    pair = near_points(first, "ya", "xa", p, "b", longest).filter((F.col("ra") < F.col("rb")) & side("a", "b").between(shortest, longest))
    tri = near_points(pair, "ya", "xa", p, "c", longest).filter((F.col("rb") < F.col("rc")) & side("a", "c").between(shortest, longest))
    return tri.filter(side("b", "c").between(shortest, longest)) if all_sides else tri


def _frames(dets: DataFrame, max_dets: int | None, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Frames of at most ``whole`` points as one row each, with all points in ``_all`` and
    the strongest in ``_pts``, and the ranked points of larger frames, if there are any."""
    size = F.count(F.lit(1)).over(W.partitionBy(*FRAME))
    ranked = settle(strongest(dets, None).withColumn("_m", size).select(*FRAME, "r", "y", "x", "strength", "_m"))
    every = F.sort_array(F.collect_list(F.struct("r", "y", "x", "strength")))
    small = ranked.filter(F.col("_m") <= whole).groupBy(*FRAME).agg(every.alias("_all")).withColumn(
        "_pts", F.col("_all") if max_dets is None else F.slice("_all", 1, max_dets))
    large = ranked.filter(F.col("_m") > whole).drop("_m")
    return small, None if large.isEmpty() else large


def _triples_within(frames: DataFrame, shortest: float, longest: float, all_sides: bool) -> DataFrame:
    """:func:`_near_triples` of frames held as arrays; a triple keeps its frame's arrays."""
    def fits(a: Column, b: Column) -> Column:
        return F.hypot(a["y"] - b["y"], a["x"] - b["x"]).between(shortest, longest)

    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    pair = frames.withColumn("_a", F.explode("_pts")).withColumn("_b", F.explode("_pts")).filter((a["r"] < b["r"]) & fits(a, b))
    tri = pair.withColumn("_c", F.explode("_pts")).filter((b["r"] < c["r"]) & fits(a, c) & (fits(b, c) if all_sides else F.lit(True)))
    return tri.select(*FRAME, *[F.col(f"_{q}.{c}").alias(f"{c}{q}") for q in "abc" for c in ("r", "y", "x", "strength")], "_pts", "_all")


def triples(dets: DataFrame, band: tuple[float, float] = (28.0, 150.0), tol: float = 0.25, max_dets: int | None = None,
            hub_frac: float | None = 0.8, top: int | None = None, whole: int = WHOLE_FRAME) -> DataFrame:
    """Near-equilateral triples of a frame's points, with a hub unless ``hub_frac`` is None.

    ``max_dets`` and ``top`` keep the strongest points and the best triples of a
    frame; by default all are kept.

    A frame of at most ``whole`` points is one row, and its triples are laid out beside its
    points.  In a larger one points meet by neighbouring cells of the longest side,
    since side lengths of such a triple lie in a band; triples whose sides disagree go.
    """
    shortest, longest = band[0] * math.sqrt(3) * (1 - tol), band[1] * math.sqrt(3) * (1 + tol)
    ab, ac, bc = (F.hypot(F.col(f"y{a}") - F.col(f"y{b}"), F.col(f"x{a}") - F.col(f"x{b}")) for a, b in ("ab", "ac", "bc"))

    def regular(tri: DataFrame, *kept: str) -> DataFrame:
        tri = tri.select(
            *FRAME, "ra", "rb", "rc",
            ((F.greatest(ab, ac, bc) - F.least(ab, ac, bc)) / ((ab + ac + bc) / 3)).alias("_spread"),
            ((F.col("ya") + F.col("yb") + F.col("yc")) / 3).alias("cy"), ((F.col("xa") + F.col("xb") + F.col("xc")) / 3).alias("cx"),
            ((F.col("strengtha") + F.col("strengthb") + F.col("strengthc")) / 3).alias("_bright"),
            *[F.col(f"{c}{q}").alias(f"_{q}{c}") for q in "abc" for c in "yx"], *kept)
        circ = sum((F.hypot(F.col(f"_{q}y") - F.col("cy"), F.col(f"_{q}x") - F.col("cx")) for q in "abc"), F.lit(0.0)) / 3
        return tri.withColumns({"regularity": F.greatest(F.lit(0.0), 1 - F.col("_spread") / tol), "circumradius": circ}).filter(
            (F.col("regularity") > 0) & F.col("circumradius").between(*band))

    out = [*FRAME, "ra", "rb", "rc", "cy", "cx", "circumradius", "regularity", "hub_distance", "_bright"]
    small, large = _frames(dets, max_dets, whole)
    tri = regular(_triples_within(small, shortest, longest, all_sides=True), "_all")
    gap = F.hypot(F.col("_q.y") - F.col("cy"), F.col("_q.x") - F.col("cx"))
    beside = tri.withColumn("_q", F.explode("_all")).drop("_all")
    if hub_frac is not None:
        beside = beside.filter(gap < hub_frac * F.col("circumradius"))
    hub = beside.groupBy(*[c for c in out if c != "hub_distance"]).agg(F.min(gap).alias("hub_distance")).select(*out)
    if large is not None:
        p = large if max_dets is None else large.filter(F.col("r") < max_dets)
        tri, every = regular(_near_triples(p, shortest, longest, all_sides=True)), large.select(*FRAME, "y", "x")
        if hub_frac is None:
            d = F.hypot(F.col("p.y") - F.col("t.cy"), F.col("p.x") - F.col("t.cx"))
            same = (F.col("t.clip_id") == F.col("p.clip_id")) & (F.col("t.f") == F.col("p.f"))
            far = tri.alias("t").join(every.alias("p"), same).groupBy(*[F.col(f"t.{c}") for c in tri.columns]).agg(F.min(d).alias("hub_distance"))
        else:
            gap = F.hypot(F.col("y_") - F.col("cy"), F.col("x_") - F.col("cx"))
            far = near_points(tri, "cy", "cx", every, "_", max(hub_frac * band[1], 1.0)).filter(
                gap < hub_frac * F.col("circumradius")).groupBy(*tri.columns).agg(F.min(gap).alias("hub_distance"))
        hub = hub.unionByName(far.select(*out))
    scored = hub.withColumn("score", F.col("regularity") * F.col("_bright"))
    w = W.partitionBy(*FRAME).orderBy(F.desc("score"), "ra", "rb", "rc")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select(
        *FRAME, "ra", "rb", "rc", "cy", "cx", "circumradius", "regularity", "hub_distance", "score", "rank")


def circles(dets: DataFrame, band: tuple[float, float] = (28.0, 150.0), min_inliers: int = 5, tol_px: float = 10.0,
            max_dets: int | None = None, whole: int = WHOLE_FRAME) -> DataFrame:
    """Circle through every triple of a frame's points (the ``max_dets`` strongest,
    if given) that enough points lie near.  A frame of at most ``whole`` points is one row.
    In a larger one the first two sides are bounded by the largest diameter, and points
    and circles meet by neighbouring cells."""
    def through(tri: DataFrame, *kept: str) -> DataFrame:
        ax, ay, bx, by, cx, cy = (F.col(n) for n in ("xa", "ya", "xb", "yb", "xc", "yc"))
        det = 2.0 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ok = F.abs(det) >= 1e-9
        ux = F.when(ok, (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / det)
        uy = F.when(ok, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / det)
        return tri.select(*FRAME, "ra", "rb", "rc", uy.alias("cy"), ux.alias("cx"), F.hypot(ay - uy, ax - ux).alias("radius"), *kept).filter(
            F.col("radius").between(*band))

    def near(y: Column, x: Column) -> Column:
        return F.abs(F.hypot(y - F.col("cy"), x - F.col("cx")) - F.col("radius")) <= tol_px

    small, large = _frames(dets, max_dets, whole)
    tri = through(_triples_within(small, 0.0, 2 * band[1], all_sides=False), "_pts")
    met = tri.withColumn("_q", F.explode("_pts")).drop("_pts").filter(near(F.col("_q.y"), F.col("_q.x")))
    found = met.drop("_q").groupBy(*[c for c in tri.columns if c != "_pts"]).agg(F.count(F.lit(1)).alias("inliers")).filter(
        F.col("inliers") >= min_inliers)
    if large is None:
        return found
    p = (large if max_dets is None else large.filter(F.col("r") < max_dets)).select(*FRAME, "r", "y", "x")
    tri = through(_near_triples(p, 0.0, 2 * band[1], all_sides=False))
    wide = near_points(tri, "cy", "cx", p.select(*FRAME, "y", "x"), "_", band[1] + tol_px).filter(near(F.col("y_"), F.col("x_")))
    return found.unionByName(wide.groupBy(*tri.columns).agg(F.count(F.lit(1)).alias("inliers")).filter(F.col("inliers") >= min_inliers))


_POWERS = [(a, b) for a in range(5) for b in range(5) if a + b <= 4]
_TERMS = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]       # u2 uv v2 u v 1


def fit_ellipses(points: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x", least: int = 5) -> DataFrame:
    """Least-squares ellipse per group; null where the conic is not an ellipse.

    The conic is the smallest eigenvector of a 6x6 matrix of normalised point
    moments, so the groups are plain sums and only those 15 numbers per group
    are solved (in batches).
    """
    keys = list(keys)
    centre = points.groupBy(*keys).agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"), F.count(F.lit(1)).alias("points"))
    centred = points.join(centre.filter(F.col("points") >= least), keys)
    size = centred.groupBy(*keys).agg(F.avg(F.hypot(F.col(y) - F.col("_my"), F.col(x) - F.col("_mx"))).alias("_s"))
    unit = centred.join(size.filter("_s > 0"), keys)
    u, v = (F.col(y) - F.col("_my")) / F.col("_s"), (F.col(x) - F.col("_mx")) / F.col("_s")
    unit = unit.withColumns({"_u": u, "_v": v})

    def power(a: int, b: int) -> Column:
        term = F.lit(1.0)
        for _ in range(a):
            term = term * F.col("_u")
        for _ in range(b):
            term = term * F.col("_v")
        return term

    moments = unit.groupBy(*keys).agg(
        F.max("points").alias("points"), F.max("_my").alias("_my"), F.max("_mx").alias("_mx"), F.max("_s").alias("_s"),
        *[F.sum(power(a, b)).alias(f"_p{a}{b}") for a, b in _POWERS])
    out = ["centre_y", "centre_x", "semi_major", "semi_minor", "angle"]
    schema = T.StructType([*[points.schema[k] for k in keys], T.StructField("points", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in out]])

    def solve(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 6, 6))
            for r, (a, b) in enumerate(_TERMS):
                for c, (p, q) in enumerate(_TERMS):
                    m[:, r, c] = pdf[f"_p{a + p}{b + q}"].to_numpy()
            a, b, c, d, e, f = np.linalg.eigh(m)[1][:, :, 0].T
            got = np.full((len(pdf), 5), np.nan)
            det = a * c - b * b / 4
            ok = det > 0
            with np.errstate(all="ignore"):
                cu = (-d / 2 * c + e / 2 * b / 2) / det
                cv = (-e / 2 * a + d / 2 * b / 2) / det
                level = f + d / 2 * cu + e / 2 * cv
                quad = np.stack([np.stack([a, b / 2], -1), np.stack([b / 2, c], -1)], -2)
                w, vec = np.linalg.eigh(quad)
                sq = -level[:, None] / w
                ok &= np.isfinite(sq).all(axis=1) & (sq > 0).all(axis=1)
                axes = np.sqrt(np.where(sq > 0, sq, np.nan))
                first = np.argmax(np.nan_to_num(axes), axis=1)
                row = np.arange(len(pdf))
                s = pdf["_s"].to_numpy()
                major, minor = axes[row, first] * s, axes[row, 1 - first] * s
                lead = vec[row, :, first]
                angle = np.arctan2(lead[:, 1], lead[:, 0])
                angle = np.where(angle <= -np.pi / 2, angle + np.pi, np.where(angle > np.pi / 2, angle - np.pi, angle))
                all_ = np.stack([cu * s + pdf["_my"].to_numpy(), cv * s + pdf["_mx"].to_numpy(), major, minor, angle], 1)
            got[ok] = all_[ok]
            yield pd.concat([pdf[[*keys, "points"]].reset_index(drop=True), pd.DataFrame(got, columns=out)], axis=1)

    return moments.mapInPandas(solve, schema).withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in out})


def ellipse_residual(points: DataFrame, ellipses: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """Radial distance of every point from its group's ellipse."""
    e = points.join(ellipses.filter("semi_major is not null"), list(keys))
    dy, dx = F.col(y) - F.col("centre_y"), F.col(x) - F.col("centre_x")
    c, s = F.cos(-F.col("angle")), F.sin(-F.col("angle"))
    r0, r1 = dy * c - dx * s, dy * s + dx * c
    norm = F.hypot(r0 / F.greatest("semi_major", F.lit(1e-9)), r1 / F.greatest("semi_minor", F.lit(1e-9)))
    return e.withColumn("residual", F.hypot(r0, r1) * F.abs(norm - 1.0) / F.greatest(norm, F.lit(1e-9)))


def ellipse_hypotheses(dets: DataFrame, keys: Sequence[str] = FRAME, band: tuple[float, float] = (28.0, 150.0),
                       tol_px: float = 2.5, min_inliers: int = 5, min_axis_ratio: float = 0.35) -> DataFrame:
    """Ellipse of each group, refitted on its inliers, scored by size of the
    rim, brightness and residual."""
    keys = list(keys)
    first = settle(fit_ellipses(dets, keys))
    sane = first.filter(F.col("semi_major").between(*band) & (F.col("semi_minor") / F.col("semi_major") >= min_axis_ratio))
    close = settle(ellipse_residual(dets, sane, keys).filter(F.col("residual") <= tol_px).select(*dets.columns))
    enough = close.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers"), F.avg("strength").alias("_bright")).filter(
        F.col("inliers") >= min_inliers)
    again = settle(fit_ellipses(close.join(enough.select(*keys), keys, "left_semi"), keys))
    resid = ellipse_residual(close, again, keys).groupBy(*keys).agg(F.avg("residual").alias("residual"))
    return again.join(enough, keys).join(resid, keys).withColumns({
        "axis_ratio": F.col("semi_minor") / F.col("semi_major"),
        "score": F.col("inliers") * F.col("_bright") * F.exp(-F.col("residual") / 2.0)}).drop("_bright")


def size_groups(hypotheses: DataFrame, radius: str = "circumradius", within: float = 0.15) -> DataFrame:
    """Group a clip's hypotheses by size, from the largest down: a group takes
    everything within ``within`` of its first member.

    On a log scale that is "first, then nothing until a fixed gap after the
    last accepted", so the refractory pick finds the group heads.
    """
    h = index_series(hypotheses.withColumn("_l", -F.log(radius)), list(CLIP), ["_l"])
    heads = refractory(h.select(*CLIP, "i", "n", BLOCK, "_l"), CLIP, "_l", -math.log(1 - within) - 1e-12)
    marked = settle(h.join(heads.select(*CLIP, "i", F.lit(1).alias("_head")), [*CLIP, "i"], "left"))
    return prefix(marked, CLIP, {"size_group": ("sum", F.coalesce("_head", F.lit(0)))}).withColumn(
        "size_group", F.col("size_group") - 1).drop("_l", "_head")


def score_groups(grouped: DataFrame) -> DataFrame:
    """Quality x frames seen x (1 + spread of centres) per size group."""
    spread = F.hypot(F.max("cy") - F.min("cy"), F.max("cx") - F.min("cx"))
    return grouped.groupBy(*CLIP, "size_group").agg(
        F.countDistinct("f").alias("frames"), F.count(F.lit(1)).alias("members"),
        (F.avg("score") * F.countDistinct("f") * (1.0 + spread)).alias("merit"))


def spread_members(rows: DataFrame, keys: Sequence[str], k: int, score: str = "score", ident: str = "event_id") -> DataFrame:
    """``k`` evenly spaced members of a group, one (the best) per frame."""
    keys = list(keys)
    best = rows.groupBy(*keys, "f").agg(F.max_by(F.struct(ident, score), F.struct(score, -F.col(ident))).alias("_b"))
    ranked = index_series(best.select(*keys, "f", "_b.*"), keys, ["f"])
    # member int(j * n / k) is taken for j = 0 .. k-1
    j = F.ceil(F.col("i") * k / F.col("n"))
    taken = (j < k) & (F.floor(j * F.col("n") / k) == F.col("i"))
    return ranked.filter((F.col("n") <= k) | taken).drop("i", "n", BLOCK)


def track_merit(track: DataFrame, keys: Sequence[str] = CLIP, full: Column | int = 3, x: str = "x", scale: str = "m_per_px_t") -> DataFrame:
    """Share of full frames x coverage x rigidity / (1 + their residual).

    A frame is full with ``full`` markers: those of the clip's model, three for a triangle.
    """
    keys = list(keys)
    whole = F.col("n_markers") >= full
    base = track.groupBy(*keys).agg(F.avg(whole.cast("double")).alias("full_share"),
                                    F.avg(F.col(x).isNotNull().cast("double")).alias("coverage"))
    q = exact_quantiles(track, keys, {
        "_r": (F.when(whole, F.col("residual_px")), 0.5), "_hi": (scale, 0.95), "_lo": (scale, 0.05)})
    rigid = 1.0 / (1.0 + (F.col("_hi") - F.col("_lo")) / 0.05)
    return base.join(q, keys, "left").select(*keys, "full_share", "coverage", F.coalesce(
        F.col("full_share") * F.col("coverage") * rigid / (1.0 + F.col("_r")), F.lit(0.0)).alias("merit"))


def metric_track(pixels: DataFrame, keys: Sequence[str] = CLIP, radius_m: float = 0.18, mid: tuple[float, float] = (80.0, 80.0),
                 seed_radius: float = 54.0) -> DataFrame:
    """Pixel centres to metres with the frame's own scale; ``shift_cm`` is how
    far that moves the height against one fixed scale."""
    keys = list(keys)
    s = F.lit(radius_m) / F.col("circumradius_px")
    p = pixels.withColumns({
        "m_per_px_t": s, "_x": (F.col("cx") - mid[1]) * s, "_h": -(F.col("cy") - mid[0]) * s,
        "_flat": -F.col("cy") * (radius_m / seed_radius)})
    ends = p.groupBy(*keys).agg(F.max("n").alias("n"), F.min("_h").alias("_h0"), F.min("_flat").alias("_f0"))
    med = exact_medians(p, keys, {"_xm": "_x"})
    q = lookup(p, keys, ends.join(med, keys))
    return q.withColumns({
        "x": F.col("_x") - F.col("_xm"), "height": F.col("_h") - F.col("_h0"),
        "shift_cm": F.abs((F.col("_h") - F.col("_h0")) - (F.col("_flat") - F.col("_f0"))) * 100,
    }).drop("_x", "_h", "_flat", "_h0", "_f0", "_xm")


def template_metric_track(pixels: DataFrame, m_per_px: float, keys: Sequence[str] = CLIP) -> DataFrame:
    """Pixel centres to metres with one scale per clip."""
    keys = list(keys)
    low = per_key(pixels, keys, F.max("cy").alias("_low"), F.min("cy").alias("_top"))
    table = low.join(exact_medians(pixels, keys, {"_xm": "cx"}), keys, "left")
    return lookup(pixels, keys, table).withColumns({
        "x": (F.col("cx") - F.col("_xm")) * m_per_px, "height": -(F.col("cy") - F.col("_low")) * m_per_px,
        "travel_m": (F.col("_low") - F.col("_top")) * m_per_px}).drop("_low", "_top", "_xm")


def calibration_report(track: DataFrame, plates: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Centre offset, rotation swing, sticker ratio and what they could hide.

    ``plates``: keys, plate_y, plate_x, plate_px, rim_y, rim_x, circumradius_px,
    m_per_px.  The swing is the unwrapped range of ``angle``.
    """
    keys = list(keys)
    swing = unwrap(track.filter("angle is not null"), keys, "angle", "_u").groupBy(*keys).agg(
        F.degrees(F.max("_u") - F.min("_u")).alias("rotation_deg"))
    offset = F.hypot(F.col("rim_y") - F.col("plate_y"), F.col("rim_x") - F.col("plate_x"))
    ratio = F.col("circumradius_px") / F.col("plate_px")
    credible = F.abs(ratio - STICKER_RATIO) <= 0.15
    arc = offset * F.least(F.radians(F.coalesce("rotation_deg", F.lit(0.0))), F.lit(2.0))
    return plates.join(swing, keys, "left").select(
        *keys, "rotation_deg", offset.alias("centre_offset_px"), ratio.alias("sticker_ratio"),
        credible.alias("credible"), F.when(credible, arc * F.col("m_per_px") * 100).alias("spacing_bias_cm"))


def similarity_fit(pairs: DataFrame, keys: Sequence[str], src: tuple[str, str] = ("sy", "sx"),
                   dst: tuple[str, str] = ("dy", "dx")) -> DataFrame:
    """Scale, angle and offset taking ``src`` to ``dst`` in least squares."""
    sy, sx, dy, dx = (F.col(c) for c in (*src, *dst))
    s = pairs.groupBy(*keys).agg(
        F.avg(sy).alias("_sy"), F.avg(sx).alias("_sx"), F.avg(dy).alias("_dy"), F.avg(dx).alias("_dx"),
        (F.covar_pop(sx, dx) + F.covar_pop(sy, dy)).alias("_re"), (F.covar_pop(sx, dy) - F.covar_pop(sy, dx)).alias("_im"),
        (F.var_pop(sx) + F.var_pop(sy)).alias("_v"))
    flat = F.col("_v") <= 0
    re, im = F.col("_re") / F.col("_v"), F.col("_im") / F.col("_v")
    re, im = F.when(flat, 1.0).otherwise(re), F.when(flat, 0.0).otherwise(im)
    return s.select(
        *keys, F.hypot(re, im).alias("scale"), F.atan2(im, re).alias("angle"),
        (F.col("_dy") - (im * F.col("_sx") + re * F.col("_sy"))).alias("offset_y"),
        (F.col("_dx") - (re * F.col("_sx") - im * F.col("_sy"))).alias("offset_x"))


# ------------------------------------------------------------ track validity --
def top_of_travel(track: DataFrame, keys: Sequence[str], values: dict[str, Column], frac: float = 0.15,
                  guard: Column | None = None) -> DataFrame:
    """Medians over the top ``frac`` of the travel (``top_<v>``) and over all."""
    keys = list(keys)
    good = F.col("height").isNotNull()
    good = good if guard is None else good & guard
    x = track.filter(good)
    ends = per_key(x, keys, F.max("height").alias("_hi"), F.min("height").alias("_lo"))
    y = lookup(x, keys, ends)
    near = F.col("height") > F.col("_hi") - frac * (F.col("_hi") - F.col("_lo"))
    return exact_medians(y, keys, {
        **{f"top_{n}": F.when(near, c) for n, c in values.items()}, **{f"all_{n}": c for n, c in values.items()}})


def template_findings(track: DataFrame, keys: Sequence[str], min_travel: float = 0.10, good: float = 0.60,
                      bands: DataFrame | None = None) -> DataFrame:
    """Refusal and warnings for a template-tracked clip, as an array of names.

    A refused clip has no other finding.  ``bands`` (keys, rom_lo, rom_hi) bounds
    the travel of clips whose lift is known.  Medians meet their bounds at nine places.
    """
    keys = list(keys)
    travel = track.groupBy(*keys).agg((F.max("height") - F.min("height")).alias("travel_m"))
    med = exact_medians(track, keys, {"score": "score"})
    top = top_of_travel(track, keys, {"score": F.col("score")}, guard=F.col("score").isNotNull()).select(*keys, "top_score")
    t = travel.join(med, keys, "left").join(top, keys, "left")
    flag = F.lit(None).cast("string")
    if bands is not None:
        t = t.join(bands.select(*keys, "rom_lo", "rom_hi"), keys, "left")
        flag = rom_flag(F.col("travel_m"), F.col("rom_lo"), F.col("rom_hi"))
    found = F.array_compact(F.array(
        F.when(F.round("score", 9) < good, F.lit("low_score")), F.when(F.round("top_score", 9) < good, F.lit("low_top_score")),
        F.concat(F.lit("travel_"), flag)))
    refused = F.coalesce(F.col("travel_m") < min_travel, F.lit(False))
    return t.withColumn("findings", F.when(refused, F.array(F.lit("refused"))).otherwise(found)).select(
        *keys, "travel_m", "score", "top_score", "findings")


def marker_findings(track: DataFrame, keys: Sequence[str], calibration: DataFrame | None = None,
                    min_travel: float = 0.10, max_top_cm: float = 0.5) -> DataFrame:
    """Refusal and warnings for a marker-tracked clip, as an array of names.

    Medians, ratios and the calibration's figures meet their bounds at nine places."""
    keys = list(keys)
    seen = F.col("height").isNotNull()
    base = track.groupBy(*keys).agg(
        (F.max("height") - F.min("height")).alias("travel_m"), F.avg(seen.cast("double")).alias("coverage"),
        F.avg(F.when(seen, (F.col("n_markers") == 2).cast("double"))).alias("two_marker_share"))
    top = top_of_travel(track, keys, {"px": F.col("residual_px"), "cm": F.col("residual_px") * F.col("m_per_px_t") * 100},
                        guard=F.col("residual_px").isNotNull())
    t = base.join(top, keys, "left").withColumn("top_ratio", F.when(F.col("all_px") > 0, F.col("top_px") / F.col("all_px")))
    rules = [
        F.when(F.col("travel_m").isNull(), "never_tracked"), F.when(F.col("travel_m") < min_travel, "static"),
        F.when(F.col("coverage") < 0.9, "coverage"), F.when(F.col("two_marker_share") > 0.25, "two_markers"),
        F.when(F.round("top_cm", 9) > max_top_cm, "top_residual").when(F.round("top_ratio", 9) > 4.0, "top_residual_ratio")]
    if calibration is not None:
        t = t.join(calibration.select(*keys, "sticker_ratio", "spacing_bias_cm"), keys, "left")
        rules += [F.when(F.round(F.abs(F.col("sticker_ratio") - STICKER_RATIO), 9) > 0.15, "sticker_ratio"),
                  F.when(F.round("spacing_bias_cm", 9) > 1.0, "spacing_bias")]
    return t.withColumn("findings", F.array_compact(F.array(*rules)))


def review(track: DataFrame, reps_found: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per clip: coverage, travel, fore-aft, rep match, plausibility.

    ``clips``: keys, expected_reps, rom_lo (metres, null when unknown).
    """
    keys = list(keys)
    ok = F.col("height").isNotNull() & F.col("x").isNotNull()
    base = track.groupBy(*keys).agg(
        F.avg(ok.cast("double")).alias("coverage"),
        ((F.max(F.when(ok, F.col("height"))) - F.min(F.when(ok, F.col("height")))) * 100).alias("travel_cm"),
        ((F.max(F.when(ok, F.col("x"))) - F.min(F.when(ok, F.col("x")))) * 100).alias("fore_aft_cm"))
    med = exact_medians(track, keys, {"residual_px": "residual_px", "score": "score"})
    n = reps_found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reps"))
    t = clips.join(base, keys, "left").join(med, keys, "left").join(n, keys, "left")
    return t.withColumns({
        "n_reps": F.coalesce("n_reps", F.lit(0)),
        "reps_match": F.col("expected_reps").isNull() | (F.col("expected_reps") == F.coalesce("n_reps", F.lit(0))),
        "implausible": F.coalesce(F.col("travel_cm") < F.col("rom_lo") * 100 * 0.9, F.lit(False))})
