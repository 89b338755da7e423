"""Ordered recursions that no window expresses, run block by block in Arrow.

Two recursions exist: a linear filter (each output needs the previous outputs)
and an event picker (each decision needs the last *accepted* event).  Both are
split in three steps so that no task ever holds a whole key:

1. every block is reduced to how it maps an incoming state to an outgoing one;
2. those small summaries are chained per key, giving each block's true state;
3. every block is evaluated again from its state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.plans.blocks import BLOCK, block_of, block_rows, over_blocks, per_key, settle


# ------------------------------------------------------------- many groups --
def each_group(
    rows: DataFrame, by: Sequence[str], order: Sequence[str],
    solve: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType,
) -> DataFrame:
    """Rows of small groups solved many groups at a time.

    ``solve`` receives whole groups, each in ``order``, and where they begin (with the
    end of the last), so that short groups cost no call of their own.  A task holds one
    Arrow batch and the group that crosses its end.  Rows already dealt by ``by`` stay
    where they are.
    """
    numbered = rows.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(*order)))

    def run(batches):
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_at").to_numpy() == 1)
            if not len(starts):
                held.append(batch)
                continue
            yield from solved([*held, batch.slice(0, starts[-1])])
            held = [batch.slice(starts[-1])]
        yield from solved(held)

    def solved(parts):
        if sum(p.num_rows for p in parts):
            table = pa.Table.from_batches(parts)
            cuts = np.r_[np.flatnonzero(table.column("_at").to_numpy() == 1), table.num_rows]
            yield from solve(table.drop_columns("_at"), cuts).to_batches()

    return numbered.mapInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return table.column(name).to_pandas().to_numpy(dtype=float)


# ------------------------------------------------------------ event picking --
def _last_accepted(t: np.ndarray, gap: float) -> np.ndarray:
    """For every position, the last one accepted if it is accepted (doubling)."""
    m = len(t)
    nxt = np.maximum(np.searchsorted(t, t + gap, side="right"), np.arange(m) + 1)
    hop = np.where(nxt < m, nxt, np.arange(m))
    while True:
        far = hop[hop]
        if np.array_equal(far, hop):
            return hop
        hop = far


def refractory(
    candidates: DataFrame, keys: Sequence[str], time: str, gap: float,
) -> DataFrame:
    """Keep the first candidate, then ignore until ``gap`` after the last kept.

    The gap is measured from the last *accepted* event, so this is not a
    session window.  ``candidates`` are sparse series rows (``i``, ``_blk``).
    """
    keys = list(keys)
    candidates = settle(candidates)
    rows = candidates.withColumn("_t", F.col(time).cast("double"))
    key_fields = [candidates.schema[k] for k in keys]
    piece_schema = T.StructType([
        *key_fields, T.StructField(BLOCK, T.LongType()),
        T.StructField("_upper", T.DoubleType()), T.StructField("_exit", T.DoubleType()),
    ])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        exit_t = t[_last_accepted(t, gap)]
        # position p can be the first accepted only if p-1 may still be blocked
        reach = np.flatnonzero(np.r_[True, t[:-1] <= t[0] + gap])
        ends = np.flatnonzero(np.r_[exit_t[reach][1:] != exit_t[reach][:-1], True])
        keep = reach[ends]
        out = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**out, BLOCK: pdf[BLOCK].iloc[0], "_upper": t[keep], "_exit": exit_t[keep]})

    state_schema = T.StructType([
        *key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("_last", T.DoubleType()),
    ])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = -math.inf, []
        for blk, part in pdf.sort_values([BLOCK, "_upper"]).groupby(BLOCK, sort=True):
            out.append((blk, last))
            upper = part["_upper"].to_numpy()
            k = int(np.searchsorted(upper, last + gap, side="right"))
            if k < len(upper):
                last = float(part["_exit"].to_numpy()[k])
        got = pd.DataFrame(out, columns=[BLOCK, "_last"])
        for k in keys:
            got[k] = pdf[k].iloc[0]
        return got[[*keys, BLOCK, "_last"]]

    # only keys whose candidates lie in several blocks need a chained state; the
    # rows meet one row per block, so they stay dealt by (key, block)
    blocks = rows.select(*keys, BLOCK).distinct()
    spread = blocks.join(blocks.groupBy(*keys).count().filter("count > 1").select(*keys), keys)
    pieces = (
        rows.join(spread, [*keys, BLOCK], "left_semi").select(*keys, BLOCK, "_t")
        .groupBy(*keys, BLOCK).applyInPandas(summarise, piece_schema)
    )
    state = pieces.groupBy(*keys).applyInPandas(chain, state_schema)
    staged = rows.join(state, [*keys, BLOCK], "left")

    # sorted partitions are walked as a stream: one pass over any number of
    # (key, block) groups, holding one Arrow batch
    ordered = staged.repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, "_t", "i")

    columns = candidates.columns

    def accept(batches):
        group, last = None, -math.inf
        for pdf in batches:
            names = [pdf[c].to_numpy() for c in (*keys, BLOCK)]
            fresh = np.zeros(len(pdf), bool)
            for c in names:
                fresh[1:] |= c[1:] != c[:-1]
            fresh[:1] = group != tuple(c[0] for c in names) if len(pdf) else False
            keep = np.zeros(len(pdf), bool)
            start = np.nan_to_num(pdf["_last"].to_numpy(dtype=float), nan=-math.inf)
            t = pdf["_t"].to_numpy()
            cuts = np.unique(np.r_[0, np.flatnonzero(fresh), len(pdf)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if fresh[a]:
                    last = float(start[a])
                k = a + int(np.searchsorted(t[a:b], last + gap, side="right"))
                while k < b:  # from accepted to accepted
                    last, keep[k] = float(t[k]), True
                    k += max(1, int(np.searchsorted(t[k:b], last + gap, side="right")))
            if len(pdf):
                group = tuple(c[-1] for c in names)
            yield pdf.loc[keep, columns]

    return ordered.mapInPandas(accept, candidates.schema)


# --------------------------------------------------------------- band filter --
def band_coefficients(lo: float, hi: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth band-pass as a digital transfer function.

    Prewarped band edges, low-pass prototype poles at 135 and 225 degrees,
    low-pass to band-pass substitution, bilinear transform.
    """
    w1, w2 = (2.0 * fs * math.tan(math.pi * f / fs) for f in (lo, hi))
    width, centre2 = w2 - w1, w1 * w2
    proto = np.exp(1j * np.pi * np.array([0.75, 1.25]))
    half = proto * width / 2.0
    root = np.sqrt(half**2 - centre2)
    poles = np.concatenate([half + root, half - root])
    z = (2.0 * fs + poles) / (2.0 * fs - poles)
    gain = width**2 * (2.0 * fs) ** 2 / np.real(np.prod(2.0 * fs - poles))
    return gain * np.array([1.0, 0.0, -2.0, 0.0, 1.0]), np.real(np.poly(z))


def band_table(lo: float, hi: float, fs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`band_coefficients` of many rates at once: five rows, a column per rate."""
    w1, w2 = (2.0 * fs * np.tan(math.pi * f / fs) for f in (lo, hi))
    width, centre2 = w2 - w1, w1 * w2
    half = np.exp(1j * np.pi * np.array([[0.75], [1.25]])) * width / 2.0
    root = np.sqrt(half**2 - centre2)
    poles = np.concatenate([half + root, half - root])
    gain = width**2 * (2.0 * fs) ** 2 / np.real(np.prod(2.0 * fs - poles, axis=0))
    a = np.zeros((5, len(fs)), complex)
    a[0] = 1.0
    for z in (2.0 * fs + poles) / (2.0 * fs - poles):
        a[1:] -= z * a[:-1].copy()
    return np.array([[1.0], [0.0], [-2.0], [0.0], [1.0]]) * gain, np.real(a)


def filter_columns(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Run the recursion down every column of ``x``, from the steady state of its first value."""
    at_rest = b.sum(0) / a.sum(0)
    state = np.zeros_like(b)
    state[:-1] = np.cumsum((b - a * at_rest)[:0:-1], axis=0)[::-1] * x[0]
    b0, b1, a1, y = b[0], b[1:], a[1:], np.empty_like(x)
    for k in range(len(x)):
        y[k] = b0 * x[k] + state[0]
        state[:-1] = state[1:] + b1 * x[k] - a1 * y[k]
    return y


def _companion(b: np.ndarray, a: np.ndarray):
    """State-space form of the direct-form-II-transposed recursion."""
    n = len(a) - 1
    A = np.zeros((n, n))
    A[:, 0] = -a[1:]
    A[:-1, 1:] = np.eye(n - 1)
    return A, b[1:] - a[1:] * b[0], b[0]


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State that a constant unit input settles to."""
    A, B, _ = _companion(b, a)
    return np.linalg.solve(np.eye(len(B)) - A, B)


def filter_block(b, a, x: np.ndarray, state: np.ndarray, lane: int = 64):
    """Run the recursion over ``x`` from ``state``; returns (output, state).

    Lanes of ``lane`` samples are answered together from zero state, then the
    true state is stepped lane by lane and its response added.
    """
    A, B, d = _companion(b, a)
    n, order = len(x), len(B)
    lanes = -(-n // lane)
    pad = np.zeros(lanes * lane)
    pad[:n] = x
    rows = pad.reshape(lanes, lane)
    powers = [np.eye(order)]
    for _ in range(lane):
        powers.append(powers[-1] @ A)
    observe = np.array([p[0] for p in powers[:lane]])          # C A^k
    impulse = np.r_[d, observe[:-1] @ B]
    toeplitz = np.zeros((lane, lane))
    for k in range(lane):
        toeplitz[k:, k] = impulse[: lane - k]
    drive = np.array([powers[lane - 1 - k] @ B for k in range(lane)])   # A^(L-1-k) B
    y = rows @ toeplitz.T
    gained = rows @ drive
    s = np.asarray(state, dtype=float)
    starts = np.empty((lanes, order))
    for k in range(lanes):
        starts[k] = s
        s = powers[lane] @ s + gained[k]
    y = (y + starts @ observe.T).reshape(-1)[:n]
    tail = n - (lanes - 1) * lane
    s = starts[-1]
    for v in rows[-1, :tail]:
        s = A @ s + B * v
    return y, s


EDGE = 15   # fixed value: three times the five filter coefficients


SHORT = 512   # rows of a key that is filtered beside others
BESIDE = 256  # keys that are


def zero_phase_band(
    series: DataFrame, keys: Sequence[str], value: str, out: str, lo: float, hi: float, fs: str = "fs",
) -> DataFrame:
    """Forward-backward band-pass of ``value``; null where a key is too short.

    The ends are extended by 15 samples reflected oddly about the end value and
    each direction starts from the steady state for its first sample.

    Keys of one block are filtered in both directions where their rows lie, many
    at a time; only longer ones go by the states of their blocks.
    """
    keys = list(keys)
    rows = block_rows(series.sparkSession)

    def solve(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        y = _both_ways(numbers(table, value), cuts, numbers(table, fs)[cuts[:-1]], lo, hi)
        short = np.repeat(np.diff(cuts) <= EDGE, np.diff(cuts))
        return table.append_column(out, pa.array(y, mask=short))

    by = [*keys, BLOCK] if BLOCK in series.columns else keys
    schema = T.StructType([*series.schema.fields, T.StructField(out, T.DoubleType())])
    whole = each_group(series.filter(F.col("n") <= rows), by, ["i"], solve, schema)
    large = series.filter(F.col("n") > rows)
    if large.isEmpty():
        return whole
    return whole.unionByName(_blocked_band(large, keys, value, out, lo, hi, fs))


def _both_ways(x: np.ndarray, cuts: np.ndarray, fs: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Zero-phase band of every stretch ``cuts[k]:cuts[k + 1]`` longer than the edge."""
    y, sizes = np.zeros(len(x)), np.diff(cuts)
    for g in np.flatnonzero(sizes > SHORT):
        v = x[cuts[g]:cuts[g + 1]]
        v = np.r_[2 * v[0] - v[EDGE:0:-1], v, 2 * v[-1] - v[-2:-EDGE - 2:-1]]
        b, a = band_coefficients(lo, hi, float(fs[g]))
        for _ in range(2):
            v = filter_block(b, a, v, steady_state(b, a) * v[0])[0][::-1]
        y[cuts[g]:cuts[g + 1]] = v[EDGE:-EDGE]
    beside = np.flatnonzero((sizes > EDGE) & (sizes <= SHORT))
    beside = beside[np.argsort(sizes[beside], kind="stable")]
    for first in range(0, len(beside), BESIDE):
        g = beside[first:first + BESIDE]
        n, start = sizes[g], cuts[:-1][g]
        k = np.arange(n.max() + 2 * EDGE)[:, None] - EDGE
        mirror = np.where(k < 0, -k, np.where(k < n, k, 2 * (n - 1) - k))
        v = x[start + np.clip(mirror, 0, n - 1)]
        v = np.where(k < 0, 2 * x[start] - v, np.where(k < n, v, 2 * x[start + n - 1] - v))
        b, a = band_table(lo, hi, fs[g])
        back = np.clip(n - 1 - k + EDGE, 0, None)      # the row in the other direction
        for _ in range(2):
            v = np.take_along_axis(filter_columns(b, a, v), back, axis=0)
        inside = (k >= 0) & (k < n)
        y[(start + k)[inside]] = v[inside]
    return y


def _blocked_band(
    series: DataFrame, keys: list[str], value: str, out: str, lo: float, hi: float, fs: str,
) -> DataFrame:
    """The same for keys of several blocks."""
    long_enough = series.filter(F.col("n") > EDGE)
    ends = per_key(
        long_enough.filter((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)), keys,
        F.max(F.when(F.col("i") == 0, F.col(value))).alias("_x0"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col(value))).alias("_x1"),
    )
    core = long_enough.select(*keys, "i", "n", F.col(fs).alias("_fs"), F.col(value).cast("double").alias("_x"))
    border = core.filter((F.col("i") <= EDGE) | (F.col("i") >= F.col("n") - 1 - EDGE)).join(
        ends.drop("n"), keys
    )
    head = border.filter((F.col("i") >= 1) & (F.col("i") <= EDGE)).select(
        *keys, (-F.col("i")).alias("i"), "n", "_fs", (2 * F.col("_x0") - F.col("_x")).alias("_x"))
    tail = border.filter((F.col("i") <= F.col("n") - 2) & (F.col("i") >= F.col("n") - 1 - EDGE)).select(
        *keys, (2 * (F.col("n") - 1) - F.col("i")).alias("i"), "n", "_fs",
        (2 * F.col("_x1") - F.col("_x")).alias("_x"))
    padded = core.unionByName(head).unionByName(tail)
    padded = settle(padded.withColumn(BLOCK, block_of(padded, F.col("i") + EDGE)))

    forward = settle(_one_way(padded, keys, lo, hi, reverse=False))
    both = _one_way(forward, keys, lo, hi, reverse=True)
    inner = both.filter((F.col("i") >= 0) & (F.col("i") < F.col("n"))).select(
        *keys, "i", F.col("_x").alias(out)
    )
    return series.join(inner, [*keys, "i"], "left")


def _one_way(padded: DataFrame, keys: list[str], lo: float, hi: float, reverse: bool) -> DataFrame:
    key_fields = [padded.schema[k] for k in keys]
    summary = T.StructType([
        *key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("_len", T.LongType()),
        T.StructField("_fs", T.DoubleType()), T.StructField("_head", T.DoubleType()),
        T.StructField("_gain", T.ArrayType(T.DoubleType())),
    ])
    state = T.StructType([
        *key_fields, T.StructField(BLOCK, T.LongType()),
        T.StructField("_state", T.ArrayType(T.DoubleType())),
    ])

    def ordered(pdf):
        pdf = pdf.sort_values("i", ascending=not reverse)
        b, a = band_coefficients(lo, hi, float(pdf["_fs"].iloc[0]))
        return pdf, b, a

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b, a = ordered(pdf)
        x = pdf["_x"].to_numpy()
        _, s = filter_block(b, a, x, np.zeros(len(a) - 1))
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, BLOCK: pdf[BLOCK].iloc[0], "_len": len(x),
                              "_fs": pdf["_fs"].iloc[0], "_head": x[0], "_gain": s}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK, ascending=not reverse)
        b, a = band_coefficients(lo, hi, float(pdf["_fs"].iloc[0]))
        A, _, _ = _companion(b, a)
        s = steady_state(b, a) * pdf["_head"].iloc[0]
        states = []
        for length, gain in zip(pdf["_len"], pdf["_gain"]):
            states.append(s)
            s = np.linalg.matrix_power(A, int(length)) @ s + np.asarray(gain)
        return pdf[[*keys, BLOCK]].assign(_state=states)

    # keys held by one block start from their own first sample: no chaining
    spread = over_blocks(
        padded.filter((F.col("i") == 0) & (F.col("n") + 2 * EDGE > block_rows(padded.sparkSession))).select(*keys, (F.col("n") + 2 * EDGE).alias("n"))
    ).select(*keys, BLOCK)
    many = padded.join(spread, [*keys, BLOCK], "left_semi")
    chained = (
        many.groupBy(*keys, BLOCK).applyInPandas(summarise, summary)
        .groupBy(*keys).applyInPandas(chain, state)
    )
    staged = padded.join(chained, [*keys, BLOCK], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b, a = ordered(pdf)
        x = pdf["_x"].to_numpy()
        s = pdf["_state"].iloc[0]
        s = steady_state(b, a) * x[0] if s is None else np.asarray(s)
        y, _ = filter_block(b, a, x, s)
        return pdf.assign(_x=y).drop(columns="_state")

    return staged.groupBy(*keys, BLOCK).applyInPandas(run, padded.schema)


# ------------------------------------------------------------ tiled products --
def tile_products(
    vectors: DataFrame, keys: Sequence[str], ident: str, vector: str, threshold: float,
    tile: int = 2048,
) -> DataFrame:
    """Within a key: per vector the number of others above ``threshold`` and the best.

    Vectors are compared tile against tile as matrix products; only one summary
    row per (vector, tile) leaves a task, never the pairs.  ``vectors`` is a
    series (``i``, ``n``), so tiles are even however skewed the keys are.
    """
    keys = list(keys)
    t = vectors.select(*keys, "n", F.col(ident).alias("_id"), F.col(vector).alias("_v"),
                       F.floor(F.col("i") / tile).cast("long").alias("_tile"))
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / tile).cast("long"))
    left = t.withColumn("_other", F.explode(tiles)).drop("n")
    # fresh names: both sides derive from one table
    right = t.withColumn("_mine", F.explode(tiles)).select(
        *[F.col(k).alias(f"r_{k}") for k in keys], F.col("_mine").alias("r_tile"), F.col("_tile").alias("r_other"),
        F.col("_id").alias("r_id"), F.col("_v").alias("r_v"))
    key_fields = [vectors.schema[k] for k in keys]
    schema = T.StructType([
        *key_fields, T.StructField("_id", vectors.schema[ident].dataType),
        T.StructField("_hits", T.LongType()), T.StructField("_best", T.DoubleType()),
        T.StructField("_best_id", vectors.schema[ident].dataType),
    ])

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        r = r.sort_values("r_id")
        a = np.stack(l["_v"].to_numpy()).astype(float)
        b = np.stack(r["r_v"].to_numpy()).astype(float)
        sim = a @ b.T
        same = l["_id"].to_numpy()[:, None] == r["r_id"].to_numpy()[None, :]
        sim = np.where(same, -np.inf, sim)
        k = sim.argmax(axis=1)
        best = sim[np.arange(len(l)), k]
        out = {c: l[c].iloc[0] for c in keys}
        return pd.DataFrame({**out, "_id": l["_id"].to_numpy(), "_hits": (sim > threshold).sum(axis=1),
                             "_best": best, "_best_id": r["r_id"].to_numpy()[k]})

    parts = left.groupBy(*keys, "_tile", "_other").cogroup(
        right.groupBy(*[f"r_{k}" for k in keys], "r_tile", "r_other")).applyInPandas(compare, schema)
    return parts.groupBy(*keys, F.col("_id").alias(ident)).agg(
        F.sum("_hits").alias("hits"), F.max("_best").alias("best"),
        F.max_by("_best_id", F.struct("_best", -F.col("_best_id"))).alias("best_id"),
    ).withColumn("best_id", F.when(F.col("best") > F.lit(float("-inf")), F.col("best_id")))


def tile_signatures(vectors: DataFrame, keys: Sequence[str], ident: str, vector: str, threshold: float,
                    tile: int = 2048) -> DataFrame:
    """Per vector the count ``_c`` and two hash sums ``_h`` of the members it is
    similar to (itself included): equal signatures mean equal sets, and no set is listed."""
    keys = list(keys)
    t = vectors.select(*keys, "n", F.col(ident).alias("_id"), F.col(vector).alias("_v"),
                       F.shiftright(F.xxhash64(F.col(ident)), 24).alias("_mark"),
                       F.shiftright(F.xxhash64(F.lit(1), F.col(ident)), 24).alias("_mark2"),
                       F.floor(F.col("i") / tile).cast("long").alias("_tile"))
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / tile).cast("long"))
    left = t.withColumn("_other", F.explode(tiles)).drop("n")
    right = t.withColumn("_mine", F.explode(tiles)).select(
        *[F.col(k).alias(f"r_{k}") for k in keys], F.col("_mine").alias("r_tile"), F.col("_tile").alias("r_other"),
        F.col("_v").alias("r_v"), F.col("_mark").alias("r_mark"), F.col("_mark2").alias("r_mark2"))
    schema = T.StructType([
        *[vectors.schema[k] for k in keys], T.StructField(ident, vectors.schema[ident].dataType),
        T.StructField("_c", T.LongType()), T.StructField("_h", T.LongType()),
        T.StructField("_h2", T.LongType())])

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        hit = np.stack(l["_v"].to_numpy()) @ np.stack(r["r_v"].to_numpy()).T > threshold
        return pd.DataFrame({**{c: l[c].iloc[0] for c in keys}, ident: l["_id"].to_numpy(),
                             "_c": hit.sum(axis=1), "_h": hit.astype(np.int64) @ r["r_mark"].to_numpy(),
                             "_h2": hit.astype(np.int64) @ r["r_mark2"].to_numpy()})

    parts = left.groupBy(*keys, "_tile", "_other").cogroup(
        right.groupBy(*[f"r_{k}" for k in keys], "r_tile", "r_other")).applyInPandas(compare, schema)
    return parts.groupBy(*keys, ident).agg(
        F.sum("_c").alias("_c"), F.struct(F.sum("_h").alias("a"), F.sum("_h2").alias("b")).alias("_h"))
