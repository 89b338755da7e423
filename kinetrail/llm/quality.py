"""Quality score of a text by a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over every byte of a document, two at a
time.  Overlapping chunks of two blocks take the maximum of each filter; the
maxima over all chunks and their mean go through a small dense layer into one
probability.  The text is processed block by block, so a long document needs no
more memory than its own bytes.

The network is fitted on the driver on a bounded sample of labelled rows
(``per_class`` documents of each label, at most ``view`` blocks of each per
pass); its weights, a few thousand numbers, travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import Adam, bounded_batches, bounded_sample, utf8

BLOCK, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 128, 8, 2, 8, 32, 16
PAD = 256  # a byte that no text has
_SLICE = 512  # blocks convolved at once


def blocks_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in padded blocks: byte numbers, and the first block of each text."""
    sizes = np.diff(ends)
    count = (sizes + WIDTH + BLOCK - 1) // BLOCK  # the last window may reach past the text, never into the next
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.full(first[-1] * BLOCK + WIDTH, PAD, np.int16)
    at = np.repeat(first[:-1] * BLOCK - ends[:-1], sizes) + np.arange(len(raw))
    out[at] = raw
    return out, first


def _windows(x: np.ndarray, w: dict[str, np.ndarray], start: int, stop: int) -> np.ndarray:
    """Filter answers of the windows that begin in blocks start..stop: (blocks, windows, filters)."""
    e = w["embed"][x[start * BLOCK:stop * BLOCK + WIDTH - STRIDE]].reshape(-1, STRIDE * EMBED)
    n = (stop - start) * (BLOCK // STRIDE)
    parts = w["filters"].reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
    out = e[:n] @ parts[0]
    for j in range(1, WIDTH // STRIDE):
        out += e[j:n + j] @ parts[j]
    return out.reshape(stop - start, BLOCK // STRIDE, FILTERS)


def _pooled(block_max: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maxima per chunk (a block and the next of its text), and the text of each chunk."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    follows = np.zeros(len(text), bool)
    follows[:-1] = text[1:] == text[:-1]
    nxt = np.where(follows, np.arange(len(text)) + 1, np.arange(len(text)))
    takes_next = block_max[nxt] > block_max
    return np.maximum(block_max, block_max[nxt]), text, nxt, takes_next


def _fill(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How far a text fills its first two blocks: a short text has few windows to answer."""
    used = np.add.reduceat(x[:first[-1] * BLOCK] != PAD, first[:-1] * BLOCK)
    return np.minimum(used / (2 * BLOCK), 1)[:, None]


def _head(chunks: np.ndarray, first: np.ndarray, fill: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    active = np.maximum(chunks + w["bias"], 0)
    top = np.maximum.reduceat(active, first[:-1], axis=0)
    mean = np.add.reduceat(active, first[:-1], axis=0) / np.diff(first)[:, None]
    z = np.concatenate([top, mean, fill, np.sqrt(fill)], axis=1)
    hidden = np.tanh(z @ w["dense"] + w["dense_bias"])
    logit = hidden @ w["out"] + w["out_bias"]
    return active, top, z, hidden, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def scores(raw: np.ndarray, ends: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of label 1 of every text."""
    if len(ends) < 2:
        return np.zeros(0)
    x, first = blocks_of(raw, ends)
    best = np.empty((first[-1], FILTERS), np.float32)
    for s in range(0, first[-1], _SLICE):
        e = min(s + _SLICE, first[-1])
        best[s:e] = _windows(x, w, s, e).max(axis=1)
    return _head(_pooled(best, first)[0], first, _fill(x, first), w)[-1].astype(np.float64)


def _gradients(raw, ends, y, weight, w):
    x, first = blocks_of(raw, ends)
    n = len(y)
    answers = _windows(x, w, 0, first[-1])
    where = answers.argmax(axis=1)
    best = np.take_along_axis(answers, where[:, None], 1)[:, 0]
    chunks, text, nxt, takes_next = _pooled(best, first)
    active, top, z, hidden, p = _head(chunks, first, _fill(x, first), w)
    d = (p - y) * weight / n
    g = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
    dh = np.outer(d, w["out"]) * (1 - hidden * hidden)
    g["dense"], g["dense_bias"] = z.T @ dh, dh.sum(axis=0)
    dz = dh @ w["dense"].T
    is_top = active == top[text]  # two chunks share a block, so its maximum may be the top of both
    of_top = dz[:, :FILTERS] / np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0)
    share = dz[text, FILTERS:2 * FILTERS] / np.diff(first)[text, None] + of_top[text] * is_top
    share = np.where(active > 0, share, 0)
    g["bias"] = share.sum(axis=0)
    to_block = np.where(takes_next, 0, share)
    np.add.at(to_block, nxt, np.where(takes_next, share, 0))
    b, f = np.nonzero(to_block)
    flow = to_block[b, f].astype(np.float32)
    begin = b * BLOCK + where[b, f] * STRIDE
    bytes_at = x[begin[:, None] + np.arange(WIDTH)]
    seen = w["embed"][bytes_at].reshape(len(b), -1)
    g["filters"] = np.zeros_like(w["filters"])
    order = np.argsort(f, kind="stable")
    cuts = np.searchsorted(f[order], np.arange(FILTERS + 1))
    for k in range(FILTERS):
        at = order[cuts[k]:cuts[k + 1]]
        g["filters"][:, k] = flow[at] @ seen[at]
    back = (flow[:, None] * w["filters"][:, f].T).reshape(-1, EMBED)
    flat = bytes_at.ravel()
    g["embed"] = np.stack([np.bincount(flat, back[:, k], PAD + 1) for k in range(EMBED)], axis=1).astype(np.float32)
    g["embed"][PAD] = 0
    return {k: v.astype(np.float32) for k, v in g.items()}


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 5, passes: int = 10, batch: int = 64,
        view: int = 24) -> dict[str, np.ndarray]:
    """Filters and dense layer by Adam; without both labels the score is constant."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"embed": normal(PAD + 1, EMBED, scale=0.5), "filters": normal(WIDTH * EMBED, FILTERS, scale=0.15),
         "bias": np.zeros(FILTERS, np.float32), "dense": normal(2 * FILTERS + 2, HIDDEN, scale=0.15),
         "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}
    w["embed"][PAD] = 0
    if len(set(labels.tolist())) < 2:
        w["out"][:] = 0
        w["out_bias"][:] = 0 if not len(labels) else 2 * labels[0] - 1
        return w
    adam = Adam(w, 0.004)
    span = view * BLOCK - WIDTH
    for turn in range(passes):
        adam.rate = 0.004 * (1 - turn / passes)
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            at = order[s:s + batch]
            cut = []
            for k in at:
                t = texts[k]
                start = int(rng.integers(0, len(t) - span)) if len(t) > span else 0
                cut.append(np.frombuffer(t[start:start + span], np.uint8))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
            adam.step(_gradients(np.concatenate(cut), ends, labels[at], weights[at], w))
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, seed: int = 5) -> dict[str, np.ndarray]:
    """Fit on ``docs`` with ``labels`` (doc_id, quality), ``per_class`` documents of each label expected.

    A label weighs as the square root of its number of rows, so that the common
    label keeps some of its prior.
    """
    found = bounded_sample(docs, labels.filter("quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")), per_class, seed)
    y = np.array([label for _, label, _ in found], np.float32)
    counts = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    raw = np.array([of ** 0.5 / counts[label] for _, label, of in found], np.float32)
    return fit([t.encode() for t, *_ in found], y, raw / raw.mean() if len(raw) else raw, seed)


def score_quality(docs: DataFrame, w: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from the text alone.

    Null and empty texts get the score of a document without bytes; repeated rows
    get equal scores; a null id stays null; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(*utf8(batch, "text"), w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")
