"""How far a reconstructed path is from its referee, and from itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.operators.motion import POSITION
from kinetrail.plans.blocks import BLOCK, lookup, neighbours, per_key, reblock, settle, windowed
from kinetrail.plans.joins import interpolate, interval_join, salted_join
from kinetrail.plans.quantiles import exact_medians, exact_quantiles


def axis_of(rows: DataFrame, keys: Sequence[str], x: str = POSITION[0], y: str = POSITION[1]) -> DataFrame:
    """Principal horizontal direction: larger eigenvector of the 2x2 sample
    covariance (pointing into x >= 0), the eigenvalue ratio, row count."""
    m = rows.groupBy(*keys).agg(
        F.var_samp(x).alias("_a"), F.var_samp(y).alias("_c"), F.covar_samp(x, y).alias("_b"), F.max("n").alias("n"))
    mid, gap = (F.col("_a") + F.col("_c")) / 2.0, (F.col("_a") - F.col("_c")) / 2.0
    root = F.sqrt(gap * gap + F.col("_b") * F.col("_b"))
    turn = 0.5 * F.atan2(2.0 * F.col("_b"), F.col("_a") - F.col("_c"))
    small = mid - root
    return m.select(
        *keys, "n", F.cos(turn).alias("axis_x"), F.sin(turn).alias("axis_y"),
        F.when(small > 0, (mid + root) / small).otherwise(F.lit(float("inf"))).alias("axis_ratio"))


def principal_axis(rows: DataFrame, keys: Sequence[str], x: str = POSITION[0], y: str = POSITION[1]) -> DataFrame:
    """:func:`axis_of` plus ``excursion``, the span along the axis."""
    axis = axis_of(rows, keys, x, y)
    along = F.col(x) * F.col("axis_x") + F.col(y) * F.col("axis_y")
    span = lookup(rows.select(*keys, BLOCK, x, y), keys, axis).groupBy(*keys).agg(
        (F.max(along) - F.min(along)).alias("excursion"))
    return axis.join(span, list(keys))


def resample(rows: DataFrame, series_next: dict[str, str], keys: Sequence[str], points: int = 100) -> DataFrame:
    """Each rep on ``points`` evenly spaced positions of its own row index.

    ``series_next`` maps value -> column holding the next row's value; every
    row emits the grid points up to its successor, in exact integer steps.
    """
    size = F.col("stop_i") - F.col("start_i")
    m = F.lit(points - 1)
    lo = F.ceil(F.col("j") * m / F.greatest(size - 1, F.lit(1)))
    hi = F.when(size == 1, m).when(F.col("j") == size - 1, m).otherwise(
        F.ceil((F.col("j") + 1) * m / F.greatest(size - 1, F.lit(1))) - 1)
    laid = rows.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter("_lo <= _hi").withColumn(
        "g", F.explode(F.sequence("_lo", "_hi")))
    frac = (F.col("g") * (size - 1) - F.col("j") * m) / m
    last = F.col("j") == size - 1
    return laid.select(*keys, "rep", "g", *[
        F.when(last, F.col(v)).otherwise(F.col(v) + (F.col(nx) - F.col(v)) * frac).alias(v)
        for v, nx in series_next.items()])


def with_next(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Next row's values as ``next_<v>``, inside the rep (``stop_i`` excluded)."""
    ahead = rows.select(
        *keys, "rep", (F.col("i") - 1).alias("i"), *[F.col(v).alias(f"next_{v}") for v in values])
    return rows.join(ahead, [*keys, "rep", "i"], "left")


def resample_reps(rows: DataFrame, keys: Sequence[str], values: Sequence[str] = POSITION, points: int = 100,
                  once: bool = False) -> DataFrame:
    """:func:`resample` of rows with their successors.  ``once`` writes those rows, not the points that they
    give: points are laid out again wherever they are read."""
    if once:
        rows = with_next(rows.select(*keys, "rep", "i", "j", "start_i", "stop_i", *values), keys, values)
        # neighbouring reps lie together, so that means over reps are added up before they are sent
        rows = settle(rows.repartition(*keys, F.floor(F.col("rep") / 64)))
        return resample(rows, {v: f"next_{v}" for v in values}, keys, points)
    return resample(with_next(rows, keys, values), {v: f"next_{v}" for v in values}, keys, points)


def deviations(grid: DataFrame, keys: Sequence[str], values: Sequence[str] = POSITION) -> DataFrame:
    """Distance of every resampled point from the mean rep.

    A mean goes to as many salts as the reps of its key take, 64 neighbouring reps sharing one.
    """
    salt = F.pmod(F.floor(F.col("rep") / 64), F.lit(16)).cast("int")
    mean = grid.groupBy(*keys, "g").agg(*[F.avg(v).alias(f"_m_{v}") for v in values], F.collect_set(salt).alias("_salts"))
    mean = mean.withColumn("_salt", F.explode("_salts")).drop("_salts")
    x = grid.withColumn("_salt", salt).join(mean, [*keys, "g", "_salt"]).drop("_salt")
    d = x.withColumns({f"d_{v}": F.col(v) - F.col(f"_m_{v}") for v in values}).drop(*[f"_m_{v}" for v in values])
    return d.withColumns({
        "horizontal": F.sqrt(F.col(f"d_{values[0]}") ** 2 + F.col(f"d_{values[1]}") ** 2),
        "vertical": F.abs(f"d_{values[2]}")})


def dispersion(grid: DataFrame, durations: DataFrame, keys: Sequence[str],
               values: Sequence[str] = POSITION) -> DataFrame:
    """Rep-to-rep spread in centimetres; keys with one rep are refused (absent).

    ``durations``: keys, rep, duration.
    """
    keys = list(keys)
    dev = deviations(grid, keys, values)
    parts = {"horizontal": "horizontal", "vertical": "vertical", **{v: f"d_{v}" for v in values}}
    # points are gathered by rep once; all but the quantiles follows from a row per rep
    per_rep = settle(dev.groupBy(*keys, "rep").agg(
        F.avg("horizontal").alias("spread"),
        *[F.struct(F.sum(F.col(c) ** 2).alias("s"), F.count(c).alias("n")).alias(f"_{p}") for p, c in parts.items()]))

    def root(part: str) -> Column:
        return F.sqrt(F.sum(f"_{part}.s") / F.sum(f"_{part}.n")) * 100

    base = per_rep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reps"), root("horizontal").alias("horizontal_rms"), root("vertical").alias("vertical_rms"),
        *[root(v).alias(f"rms_{v}") for v in values])
    p95 = exact_quantiles(dev, keys, {"_h": ("horizontal", 0.95), "_v": ("vertical", 0.95)}).select(
        *keys, (F.col("_h") * 100).alias("horizontal_p95"), (F.col("_v") * 100).alias("vertical_p95"))
    worst = per_rep.groupBy(*keys).agg(F.max_by("rep", F.struct("spread", -F.col("rep"))).alias("worst_rep"))
    med = exact_medians(durations, keys, {"_md": "duration"})
    tempo = per_rep.join(durations, [*keys, "rep"])
    tempo = salted_join(tempo, med, keys, F.col("rep")).withColumn("_off", F.abs(F.col("duration") - F.col("_md")))
    corr = tempo.groupBy(*keys).agg(guarded_corr("_off", "spread", 5).alias("tempo_corr"))
    return base.filter("n_reps >= 2").join(p95, keys).join(worst, keys).join(corr, keys, "left")


def guarded_corr(a: str, b: str, least: int = 5, flat: float = 1e-9) -> Column:
    """Pearson correlation, null for few points or no spread."""
    enough = (F.count(F.lit(1)) >= least) & (F.stddev_pop(a) > flat) & (F.stddev_pop(b) > flat)
    return F.when(enough, F.corr(a, b))


def coverage(reps: DataFrame, track: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``covered``: the rep lies wholly inside the track's time span.

    ``reps`` carries t0 and t1."""
    span = track.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return reps.join(span, list(keys), "left").withColumn(
        "covered", F.coalesce((F.col("t0") >= F.col("_a")) & (F.col("t1") <= F.col("_b")), F.lit(False))
    ).drop("_a", "_b")


REFUSED_LIFTS = ("squat",)   # fixed value: lifts whose track leaves the picture at the top


def _root_mean(a: Column, b: Column | None = None) -> Column:
    d = a if b is None else a - b
    return F.sqrt(F.avg(d * d)) * 100


def against_track(paths: DataFrame, track: DataFrame, keys: Sequence[str],
                  lifts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score reconstructed reps against a referee already on the same clock.

    ``paths`` are rep rows (:func:`kinetrail.operators.correct.cut` columns)
    with the corrected path ``px py pz`` and the uncorrected ``bx by bz``.
    Returns (per rep, per key, curves).  One sign is chosen per key, from the
    summed agreement of all its covered reps.

    ``lifts`` (keys, lift) names the lift of each key: a track of a squat is no
    referee, so those keys have no scores, only a ``refusal`` in the second table.
    """
    keys = list(keys)
    axis = axis_of(paths, keys)
    span = track.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    facts = axis.join(span, keys, "left")
    if lifts is not None:
        facts = facts.join(lifts.select(*keys, F.col("lift").isin(*REFUSED_LIFTS).alias("_refused")), keys, "left")
    rows = lookup(paths, keys, facts)
    if lifts is not None:
        rows = rows.filter(~F.coalesce("_refused", F.lit(False))).drop("_refused")
    rows = rows.withColumn("covered", F.coalesce(
        (F.col("t0") >= F.col("_a")) & (F.col("t0") + F.col("duration") <= F.col("_b")), F.lit(False)))
    seen = rows.groupBy(*keys, "rep").agg(F.max("covered").alias("covered"))
    need = [*keys, "t", "rep", "i", "start_i", "stop_i", "j", "tau", "duration", "axis_x", "axis_y",
            "px", "py", "pz", "bx", "by", "bz"]
    live = interpolate(rows.filter("covered").select(*need), track.select(*keys, "t", "x", "height"), keys, "t", ["x", "height"])
    first = live.filter("j = 0").select(
        *keys, "rep", F.col("x").alias("_x0"), F.col("height").alias("_h0"),
        *[F.col(c).alias(f"_{c}") for c in ("px", "py", "pz", "bx", "by", "bz")])
    last = live.filter("j = stop_i - start_i - 1").select(
        *keys, "rep", F.col("x").alias("_x1"), F.col("height").alias("_h1"))
    live = salted_join(live, first.join(last, [*keys, "rep"]), [*keys, "rep"], F.col("j"))

    def along(a: str, b: str) -> Column:
        return (F.col(a) - F.col(f"_{a}")) * F.col("axis_x") + (F.col(b) - F.col(f"_{b}")) * F.col("axis_y")

    share = F.when(F.col("duration") > 0, F.col("tau") / F.col("duration")).otherwise(0.0)
    live = live.select(
        *keys, "rep", "i", "j", "t", "tau", "duration",
        (F.col("x") - F.col("_x0")).alias("ref_u"), (F.col("height") - F.col("_h0")).alias("ref_h"),
        (F.col("x") - F.col("_x0") - share * (F.col("_x1") - F.col("_x0"))).alias("closed_u"),
        (F.col("height") - F.col("_h0") - share * (F.col("_h1") - F.col("_h0"))).alias("closed_h"),
        F.abs(F.col("_x1") - F.col("_x0")).alias("_cu"), F.abs(F.col("_h1") - F.col("_h0")).alias("_ch"),
        along("px", "py").alias("pipe_u"), (F.col("pz") - F.col("_pz")).alias("pipe_h"),
        along("bx", "by").alias("raw_u"), (F.col("bz") - F.col("_bz")).alias("raw_h"))
    agree = live.groupBy(*keys, "rep").agg(
        (F.covar_pop("pipe_u", "ref_u") * F.count(F.lit(1))).alias("agree"))
    sign = agree.groupBy(*keys).agg(
        (F.sum("agree") < 0).alias("flipped"),
        F.sum(F.when(F.col("agree") < 0, 1).otherwise(0)).alias("_neg"), F.count(F.lit(1)).alias("_all"))
    sign = sign.withColumn("disagreeing", F.when(F.col("flipped"), F.col("_all") - F.col("_neg")).otherwise(F.col("_neg")))
    live = salted_join(live, sign.select(*keys, "flipped"), keys, F.floor(F.col("i") / 1024))
    turn = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    live = live.withColumns({"pipe_u": F.col("pipe_u") * turn, "raw_u": F.col("raw_u") * turn})
    c = F.col
    per_rep = live.groupBy(*keys, "rep").agg(
        _root_mean(c("raw_u"), c("ref_u")).alias("raw_h_rms"), _root_mean(c("raw_h"), c("ref_h")).alias("raw_v_rms"),
        _root_mean(c("pipe_u"), c("ref_u")).alias("pipeline_h_rms"),
        (F.max(F.abs(c("pipe_u") - c("ref_u"))) * 100).alias("pipeline_h_max"),
        _root_mean(c("pipe_h"), c("ref_h")).alias("pipeline_v_rms"),
        (F.max(F.abs(c("pipe_h") - c("ref_h"))) * 100).alias("pipeline_v_max"),
        _root_mean(c("pipe_u"), c("closed_u")).alias("closed_h_rms"),
        _root_mean(c("pipe_h"), c("closed_h")).alias("closed_v_rms"),
        (F.max("_cu") * 100).alias("video_closure_h"), (F.max("_ch") * 100).alias("video_closure_v"),
        ((F.max("ref_h") - F.min("ref_h")) * 100).alias("video_rom_cm"),
        ((F.max("ref_u") - F.min("ref_u")) * 100).alias("video_fore_aft_cm"),
        _root_mean(c("ref_u")).alias("null_h_rms"))
    measures = [m for m in per_rep.columns if m not in (*keys, "rep")]
    med = exact_medians(per_rep, keys, {m: m for m in measures})
    per_capture = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reps"), F.sum(F.col("covered").cast("int")).alias("n_compared")
    ).join(sign.select(*keys, "flipped", "disagreeing"), keys, "left").join(med, keys, "left").withColumn(
        "beats_null", c("null_h_rms") / c("pipeline_h_rms"))
    if lifts is not None:
        refused = facts.filter("_refused").select(*keys, F.lit("squat track").alias("refusal"))
        per_capture = per_capture.withColumn("refusal", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
    return seen.join(per_rep, [*keys, "rep"], "left"), per_capture, live.drop("_cu", "_ch")


def closure_between(series: DataFrame, marks: DataFrame, events: DataFrame, keys: Sequence[str],
                    accel: str = "wz") -> DataFrame:
    """Velocity change between neighbouring marks, and whether an event lies
    inside.  ``marks`` are rows (i, t) known to be at rest; ``[i, next)``."""
    pair = neighbours(marks, keys, {"_ni": "i", "_nt": "t"}, step=1).filter("_ni is not null")
    spans = pair.select(*keys, F.col("i").alias("start_i"), F.col("_ni").alias("stop_i"),
                        F.col("t").alias("t_start"), (F.col("_nt") - F.col("t")).alias("duration_s"))
    area = interval_area(series, spans, keys, accel, "dv")
    hit = interval_join(events.select(*keys, "i", BLOCK), spans, keys).select(*keys, "start_i").distinct().withColumn("_hit", F.lit(True))
    return spans.join(area.select(*keys, "start_i", "dv"), [*keys, "start_i"], "left").join(
        hit, [*keys, "start_i"], "left").withColumn("spans_impact", F.coalesce("_hit", F.lit(False))).drop("_hit")


def interval_area(series: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str, out: str,
                  time: str = "t") -> DataFrame:
    """Trapezoid integral of ``value`` over the rows of each interval."""
    x = windowed(series, keys, lambda w: {"_slab": F.coalesce(
        (F.col(value) + F.lag(value).over(w)) / 2.0 * (F.col(time) - F.lag(time).over(w)), F.lit(0.0))}, before=1)
    names = [c for c in intervals.columns if c not in (BLOCK, "n")]
    got = interval_join(x.select(*keys, "i", BLOCK, "_slab"), intervals.select(*names), keys)
    # the first row's slab reaches outside the interval
    own = F.when(F.col("i") > F.col("start_i"), F.col("_slab")).otherwise(0.0)
    return got.groupBy(*names).agg(F.sum(own).alias(out))


def at_or_after(series: DataFrame, instants: DataFrame, keys: Sequence[str], at: str, values: Sequence[str],
                reach: float, time: str = "t") -> DataFrame:
    """First sample at or after each instant (``searchsorted``), within ``reach``.

    ``instants`` rows keep all their columns and gain ``found_i`` and
    ``found_<v>``; none within reach leaves nulls.
    """
    from kinetrail.plans.joins import time_range_join

    win = instants.withColumns({"_lo": F.col(at), "_hi": F.col(at) + reach})
    near = time_range_join(series.select(*keys, "i", time, *values), win.withColumnsRenamed(
        {c: f"q_{c}" for c in instants.columns if c not in keys}), keys, time, "_lo", "_hi", max(reach, 1e-6))
    ask = [c for c in instants.columns if c not in keys]
    first = near.groupBy(*keys, *[f"q_{c}" for c in ask]).agg(
        F.min_by(F.struct("i", *values), "i").alias("_f"))
    renamed = first.select(*keys, *[F.col(f"q_{c}").alias(c) for c in ask], F.col("_f.i").alias("found_i"),
                           *[F.col(f"_f.{v}").alias(f"found_{v}") for v in values])
    return instants.join(renamed, [*keys, *ask], "left")


def leave_one_out(rows: DataFrame, keys: Sequence[str], value: str, out: str = "others_mean") -> DataFrame:
    """Mean of the group's other members."""
    total = rows.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    x = salted_join(rows, total, keys, F.xxhash64(value))
    return x.withColumn(out, F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1))).drop("_s", "_n")


def average_rank(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of ties, counted per distinct value so a hot value is one row."""
    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    from kinetrail.plans.blocks import index_series, prefix

    placed = index_series(per, keys, [value])
    below = prefix(placed, keys, {"_upto": ("sum", "_c")})
    rank = below.select(*keys, value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    return rows.join(rank, [*keys, value])


def spearman(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(rows, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("points"))


def polynomial_residual(rows: DataFrame, keys: Sequence[str], error: str, u: str, order: int) -> DataFrame:
    """rms left after the best line or parabola in ``u``, from power sums."""
    x, e = F.col(u), F.col(error)
    powers = [F.sum(x**p).alias(f"_s{p}") for p in range(2 * order + 1)]
    cross = [F.sum(e * x**p).alias(f"_m{p}") for p in range(order + 1)]
    s = rows.groupBy(*keys).agg(*powers, *cross, F.sum(e * e).alias("_ee"))
    size = order + 1
    matrix = [[F.col(f"_s{r + c}") for c in range(size)] for r in range(size)]
    right = [F.col(f"_m{r}") for r in range(size)]
    det = _det(matrix)
    coef = [_det([[right[r] if c == k else matrix[r][c] for c in range(size)] for r in range(size)]) / det
            for k in range(size)]
    explained = coef[0] * right[0]
    for k in range(1, size):
        explained = explained + coef[k] * right[k]
    left = F.greatest(F.col("_ee") - explained, F.lit(0.0)) / F.col("_s0")
    return s.select(*keys, F.sqrt(left).alias("residual_rms"))


def _det(m) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = None
    for c in range(len(m)):
        minor = [[row[k] for k in range(len(m)) if k != c] for row in m[1:]]
        term = m[0][c] * _det(minor)
        total = term if total is None else (total + term if c % 2 == 0 else total - term)
    return total


def bootstrap_axis(rows: DataFrame, keys: Sequence[str], replicates: int = 200, seed: int = 7,
                   x: str = POSITION[0], y: str = POSITION[1]) -> DataFrame:
    """Spread of the principal axis when reps are redrawn with replacement.

    Reps are reduced to their moment sums first.  A replicate draws rep numbers
    by hashing (seed, replicate, draw), so it is the same on every run.
    """
    keys = list(keys)
    m = rows.groupBy(*keys, "rep").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"),
        F.sum(F.col(x) ** 2).alias("_xx"), F.sum(F.col(y) ** 2).alias("_yy"), F.sum(F.col(x) * F.col(y)).alias("_xy"))
    from kinetrail.plans.blocks import index_series

    numbered = index_series(m, keys, ["rep"]).drop(BLOCK)
    total = numbered.groupBy(*keys).agg(F.max("n").alias("_reps"))
    draws = numbered.select(*keys, F.col("i").alias("draw")).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).join(total, keys).withColumn(
        "i", F.pmod(F.xxhash64(F.lit(seed), "replicate", "draw"), F.col("_reps")))
    drawn = draws.join(numbered, [*keys, "i"]).groupBy(*keys, "replicate").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_x", "_y", "_xx", "_yy", "_xy")], F.max("_reps").alias("n_reps"))
    vx = F.col("_xx") - F.col("_x") ** 2 / F.col("_n")
    vy = F.col("_yy") - F.col("_y") ** 2 / F.col("_n")
    vxy = F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")
    from kinetrail.functions.geometry import circular_spread_180

    angle = F.degrees(0.5 * F.atan2(2.0 * vxy, vx - vy))
    return drawn.withColumn("_angle", angle).groupBy(*keys).agg(
        F.max("n_reps").alias("n_reps"), F.count(F.lit(1)).alias("replicates"),
        circular_spread_180(F.col("_angle")).alias("spread_deg"))
