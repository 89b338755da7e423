"""Language of a text by a bidirectional gated recurrent network over bytes.

Every byte gets a state from its left and one from its right context (two gated
recurrent layers over chunks of ``CHUNK`` bytes), a softmax over the two labels
the position, and the mean of the position probabilities over the whole text
decides the document.  Chunks of all texts of a batch run side by side, so a
step of the recurrence is a few array operations, and a long text is only more
chunks.

The network is trained in numpy by backpropagation through time on a bounded
sample (``per_language`` documents of each language expected, ``PER_DOC`` chunks
of each per pass); its weights travel with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import Adam, bounded_batches, bounded_sample, utf8

CHUNK, STATE, PAD, PER_DOC = 96, 8, 256, 6
_SIDE = 4096  # chunks that run side by side
_LETTER = re.compile(r"[^\W\d_]")


def chunks_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (chunks, CHUNK) with padding, and the first chunk of each text."""
    sizes = np.diff(ends)
    first = np.concatenate([[0], np.cumsum(-(-sizes // CHUNK))])
    out = np.full(first[-1] * CHUNK, PAD, np.int16)
    out[np.repeat(first[:-1] * CHUNK - ends[:-1], sizes) + np.arange(len(raw))] = raw
    return out.reshape(-1, CHUNK), first


def _scan(x: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool):
    """States (CHUNK, n, STATE) of one direction; with ``keep``, also the gates."""
    n = len(x)
    table, gates_u, new_u = w[f"in_{side}"], w[f"gates_{side}"], w[f"new_{side}"]
    h = np.zeros((n, STATE), np.float32)
    states = np.empty((CHUNK, n, STATE), np.float32)
    kept = []
    for t in range(CHUNK) if side == "f" else range(CHUNK - 1, -1, -1):
        drive = table[x[:, t]]
        zr = np.tanh(drive[:, :2 * STATE] + h @ gates_u)  # tanh(x / 2), as the halves are in the weights
        zr += 1
        zr *= 0.5
        z, r = zr[:, :STATE], zr[:, STATE:]
        u = h @ new_u
        new = np.tanh(drive[:, 2 * STATE:] + r * u)
        if keep:
            kept.append((t, h, z, r, u, new))
        h = new + z * (h - new)
        states[t] = h
    return (states, kept) if keep else states


def _positions(f: np.ndarray, b: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    logits = f @ w["out"][:STATE] + b @ w["out"][STATE:] + w["out_bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def probabilities(raw: np.ndarray, ends: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Mean position probabilities (texts, languages); a text without bytes has zeros."""
    x, first = chunks_of(raw, ends)
    sums = np.zeros((len(x), w["out"].shape[1]))
    for s in range(0, len(x), _SIDE):
        part = x[s:s + _SIDE]
        p = _positions(_scan(part, w, "f", False), _scan(part, w, "b", False), w)
        p *= (part != PAD).T[:, :, None]
        sums[s:s + _SIDE] = p.sum(axis=0)
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(ends), 1)[:, None]


def _gradients(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    (f, kept_f), (b, kept_b) = _scan(x, w, "f", True), _scan(x, w, "b", True)
    d = _positions(f, b, w)
    d[:, np.arange(len(y)), y] -= 1
    mask = (x != PAD).T[:, :, None]
    d = d * mask / mask.sum()
    g = {"out": np.concatenate([np.tensordot(f, d, ([0, 1], [0, 1])), np.tensordot(b, d, ([0, 1], [0, 1]))]),
         "out_bias": d.sum(axis=(0, 1))}
    for side, kept, part in (("f", kept_f, w["out"][:STATE]), ("b", kept_b, w["out"][STATE:])):
        gates_u, new_u = w[f"gates_{side}"], w[f"new_{side}"]
        g_gates, g_new = np.zeros_like(gates_u), np.zeros_like(new_u)
        drive = np.zeros((CHUNK, len(x), 3 * STATE), np.float32)
        back = d @ part.T
        dh = np.zeros((len(x), STATE), np.float32)
        for t, h, z, r, u, new in reversed(kept):
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z) * 2  # the weights hold halves
            dr = dn * u * r * (1 - r) * 2
            du = dn * r
            dg = np.concatenate([dz, dr], axis=1)
            drive[t, :, :2 * STATE], drive[t, :, 2 * STATE:] = dg, dn
            g_gates += h.T @ dg
            g_new += h.T @ du
            dh = dh * z + dg @ gates_u.T + du @ new_u.T
        flat, rows = x.T.ravel(), drive.reshape(-1, 3 * STATE)
        order = np.argsort(flat, kind="stable")
        seen, begin = np.unique(flat[order], return_index=True)
        table = np.zeros_like(w[f"in_{side}"])
        table[seen] = np.add.reduceat(rows[order], begin, axis=0)
        g |= {f"in_{side}": table, f"gates_{side}": g_gates, f"new_{side}": g_new}
    norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
    return {k: (v / max(1.0, norm)).astype(np.float32) for k, v in g.items()}


def fit(texts: list[bytes], labels: np.ndarray, languages: int, seed: int = 3, passes: int = 5, batch: int = 192) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"out": normal(2 * STATE, max(languages, 1), scale=0.3), "out_bias": np.zeros(max(languages, 1), np.float32)}
    for side in "fb":
        w |= {f"in_{side}": normal(PAD + 1, 3 * STATE, scale=0.4), f"gates_{side}": normal(STATE, 2 * STATE, scale=0.2),
              f"new_{side}": normal(STATE, STATE, scale=0.3)}
    texts_labels = [(t, y) for t, y in zip(texts, labels) if t]
    if languages < 2 or not texts_labels:
        return w
    adam = Adam(w, 0.02)
    for turn in range(passes):
        adam.rate = 0.02 * (1 - turn / passes) + 0.001
        rows, y = [], []
        for t, label in texts_labels:
            for _ in range(min(PER_DOC, -(-len(t) // CHUNK))):
                start = int(rng.integers(0, max(1, len(t) - CHUNK + 1)))
                row = np.full(CHUNK, PAD, np.int16)
                piece = np.frombuffer(t[start:start + CHUNK], np.uint8)
                row[:len(piece)] = piece
                rows.append(row)
                y.append(label)
        x, y = np.stack(rows), np.array(y)
        order = rng.permutation(len(x))
        for s in range(0, len(order), batch):
            at = order[s:s + batch]
            adam.step(_gradients(x[at], y[at], w))
    return w


def train(docs: DataFrame, per_language: int = 500, seed: int = 3) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, weights) from (doc_id, text, lang), ``per_language`` documents of each expected."""
    found = bounded_sample(docs, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label")),
                           per_language, seed)
    languages = sorted({label for _, label, _ in found})
    labels = np.array([languages.index(label) for _, label, _ in found], np.int64)
    return languages, fit([t.encode() for t, *_ in found], labels, len(languages), seed)


def predict(docs: DataFrame, languages: list[str], w: dict[str, np.ndarray],
            keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone, and the columns ``keep`` as they are.

    A text that is null or has no letter is ``und`` with score 0; so is every text
    if no language was learned.  Repeated rows get equal predictions; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(*utf8(batch, "text"), w) if batch.num_rows else np.zeros((0, 1))
            best = p.argmax(axis=1)
            known = [bool(t and languages and _LETTER.search(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k) for k in range(2, batch.num_columns)],
                batch.column(0), pa.array([languages[k] if ok else "und" for k, ok in zip(best, known)], pa.string()),
                pa.array(np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0), pa.float64())],
                names=[*keep, "doc_id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    kept = "".join(f"{c} {kinds[c]}, " for c in keep)
    # the kept columns travel under numbers: they may be named as ours
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)]).mapInArrow(
        run, f"{kept}doc_id long, lang_pred string, score double")
