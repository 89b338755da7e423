"""Packing documents into fixed windows by non-negative least squares.

1. Tokenise every document in tasks; cut it into full windows and one remainder.
2. Count remainders by length (from 16 quanta on rounded up to ``quantum``): fewer
   than ``16 quantum + window / quantum`` numbers, whatever the corpus.
3. Enumerate the combinations of up to three lengths that fill the window, solve
   for how often each should repeat (``min |A x - h|, x >= 0``), round down, and
   pack what is left greedily, still on the histogram.
4. Number the pieces of each length and look up their place in the plan.

The plan is the only thing on the driver, and its size depends on the window
alone.  Pieces of one length never meet in one task: they are numbered by
(slice, length) counters.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches
from kinetrail.plans.stage import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, slice int, rank long"
_WORDS = 300_000  # words of one generation; two are held


# ------------------------------------------------------------- tokenising ---


class WordTokens:
    """Ids of texts, remembering the ids of words a worker has met before.

    The tokenizer never joins across blanks, so a text's ids are those of its words
    in order.  Words are counted out by Arrow, and each different word of a batch is
    looked up once.  The memory has two generations: a full one becomes the old one,
    from which words in use return.  Results do not depend on it.

    A word not met before is encoded by the tokenizer as it is, added tokens
    included.  Latin-1 letters with ASCII signs after them, which is most words, are
    two pieces to the tokenizer, lower-cased; their merges are applied by
    ``tiktoken``, which takes a piece at a time without the cost of a call for whole
    texts.
    """

    _LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)\Z")
    # bytes of such pieces, lower-cased, in UTF-8; the other values stand for the last byte of a piece
    _BYTES = [*range(0x21, 0x41), *range(0x5B, 0x7F), *range(0x9F, 0xC0), 0xC3]
    _LAST = dict(zip(_BYTES, (bytes((k,)) for k in sorted(set(range(256)) - set(_BYTES)))))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self._latin_pieces(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def _latin_pieces(cls, path: str):
        """(encoder of a piece's bytes to ranks, id of each rank).

        A token ranks by its place among the merges, so the pair to merge first has
        the least rank, as the tokenizer merges.
        """
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        # a vocabulary writes printable bytes as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(shown))
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        single = [t for t in model["vocab"] if len(t.removesuffix(end)) == 1]
        ranks, ids = {}, []
        for token in single + merged:
            raw = bytes(byte_of[c] for c in token.removesuffix(end))
            if all(b in cls._LAST for b in raw):
                ranks[raw[:-1] + cls._LAST[raw[-1]] if token.endswith(end) else raw] = len(ids)
                ids.append(model["vocab"][token])
        coder = Encoding("latin pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return coder._core_bpe.encode_single_piece, ids

    def _learn(self, missing: list[str]) -> None:
        """Words not met lately."""
        (encode, id_of), last = self.pieces, self._LAST
        rest = []
        for word in missing:
            if m := self._LETTERS_SIGNS.match(word):
                found = []
                for piece in filter(None, m.groups()):
                    raw = piece.lower().encode()
                    found += encode(raw[:-1] + last[raw[-1]])
                self.words[word] = struct.pack(f"<{len(found)}I", *[id_of[k] for k in found])
            else:
                rest.append(word)
        for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.words[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def batch_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n+1 ends of the texts; null counts as empty."""
        if len(self.words) > _WORDS:
            self.old, self.words = self.words, {}
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        missing = [w for w in words if w not in self.words]
        old = self.old
        self.words.update((w, old[w]) for w in missing if w in old)
        self._learn([w for w in missing if w not in old])
        known = [self.words[w] for w in words]
        pool = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        stop = np.cumsum(n)
        ids = pool[np.repeat(begins[at] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        lists = split.offsets.to_numpy().astype(np.int64)
        return ids, np.r_[0, stop][lists - lists[0]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.batch_ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str, keep: bool) -> WordTokens:
    """The worker's tokenizer, or one of the task's own."""
    if not keep:
        return WordTokens(path)
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def planned_length(n: int, quantum: int) -> int:
    """The length that the plan counts for a piece: itself if short, else rounded up to ``quantum``.

    Rounding starts where it costs a sixteenth at most.
    """
    return n if n < 16 * quantum else -(-n // quantum) * quantum


def tokenised_pieces(docs: DataFrame, path: str, end_id: int, window: int, quantum: int,
                     id_col: str, text_col: str, keep_words: bool) -> DataFrame:
    """One row per piece: full windows first, then the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = _tokens(path, keep_words), TaskContext.get().partitionId()
        counts = np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            ids, ends = tokens.batch_ids(batch.column(1))
            for doc, first, last in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                own = np.concatenate([ids[first:last], end])
                n = len(own)
                for start in range(0, n, window):
                    length = min(window, n - start)
                    b = planned_length(length, quantum)
                    rows.append((doc, start, length, zlib.crc32(own[start:start + length]), n, b, task, counts[b]))
                    counts[b] += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "slice", "rank")
            types = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=list(names))

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- the plan ---


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Every combination of two or three of the (ascending) lengths whose sum is ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out: list[tuple[int, ...]] = [(a, window - a) for a in lengths.tolist() if a < window <= 2 * a and there[window - a]]
    for a in lengths[(lengths < window) & (3 * lengths >= window)].tolist():
        rest = window - a
        b = lengths[(lengths <= a) & (lengths < rest) & (2 * lengths >= rest)]
        out += [(a, k, rest - k) for k in b[there[rest - b]].tolist()]
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 200, at_once: int = 24) -> np.ndarray:
    """Active-set non-negative least squares; several columns enter per round."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    floor = 1e-9 * max(1.0, float(np.abs(h).max(initial=0.0)))
    for _ in range(rounds):
        slope = a.T @ (h - a @ x)
        slope[active] = -np.inf
        enter = np.argsort(-slope, kind="stable")[:at_once]
        enter = enter[slope[enter] > floor]
        if not len(enter):
            break
        active[enter] = True
        while active.any():
            idx = np.flatnonzero(active)
            part = a[:, idx]
            z = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(idx)), part.T @ h)
            if (z > 0).all():
                x[:] = 0
                x[idx] = z
                break
            bad = z <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - z[bad], 1e-300))
            x[idx] += step * (z - x[idx])
            drop = idx[(x[idx] <= 1e-12) & bad]
            x[drop] = 0
            active[drop if len(drop) else idx[bad]] = False
    return x


def packing_plan(histogram: np.ndarray, bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) whose pieces are the histogram's exactly; ``bins`` is the window, an index a length."""
    left = histogram.astype(np.int64).copy()
    plan = []
    if left[bins]:
        plan.append(((bins,), int(left[bins])))
        left[bins] = 0
    if left.any():
        lengths = np.flatnonzero(left)
        shapes = combinations(lengths, bins)
        if shapes:
            row = {b: k for k, b in enumerate(lengths.tolist())}
            a = np.zeros((len(lengths), len(shapes)))
            for k, c in enumerate(shapes):
                for b in c:
                    a[row[b], k] += 1
            x = nnls(a, left[lengths].astype(float))
            for k in np.argsort(-x, kind="stable"):
                uses = {b: shapes[k].count(b) for b in shapes[k]}
                times = min(int(x[k] + 1e-6), *(int(left[b]) // u for b, u in uses.items()))
                if times > 0:
                    plan.append((shapes[k], times))
                    for b, u in uses.items():
                        left[b] -= u * times
    while left.any():  # each round uses up one length at least
        shape, room = {}, bins
        for b in np.flatnonzero(left)[::-1].tolist():
            if k := min(room // b, int(left[b])):
                shape[b] = k
                room -= k * b
        times = min(int(left[b]) // k for b, k in shape.items())
        plan.append((tuple(b for b, k in shape.items() for _ in range(k)), times))
        for b, k in shape.items():
            left[b] -= k * times
    return plan


def pack(docs: DataFrame, path: str, end_id: int, window: int = 4096, quantum: int = 8,
         id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """Pieces of every document with their sequence and the place in it.

    A null text counts as empty and holds the end id alone; a null id stays null;
    repeated rows are documents of their own; an empty table gives no rows; other
    columns are not read.  Columns: those of the contract, then ``slot`` (place of
    the piece among those of its sequence).  With ``keep_words`` a worker remembers
    words from task to task, which is faster and takes memory.
    """
    if window % quantum:
        raise ValueError("the window must be a multiple of the quantum")
    pieces = written(tokenised_pieces(docs, path, end_id, window, quantum, id_col, text_col, keep_words), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for b, n in pieces.groupBy("bin").count().collect():  # at most 16 quanta and window / quantum rows
        histogram[b] = n
    plan = packing_plan(histogram, window)

    # for each length: where a run of ranks goes, in rank order
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(window + 1, np.int64)
    first = 0
    for shape, times in plan:
        for slot, b in enumerate(shape):
            runs.setdefault(b, []).append((int(used[b]), first, slot))
            used[b] += times
        first += times
    places = {b: np.array(r, np.int64) for b, r in runs.items()}

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of a length in earlier slices, from one row per length."""
        for frame in frames:
            for b, rows in zip(frame["bin"], frame["counts"]):
                ordered = sorted((r["slice"], r["n"]) for r in rows)
                n = np.array([r[1] for r in ordered], np.int64)
                yield pd.DataFrame({"bin": np.int32(b), "slice": np.array([r[0] for r in ordered], np.int32),
                                    "before": np.cumsum(n) - n})

    before = (pieces.groupBy("bin", "slice").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("bin").agg(F.collect_list(F.struct("slice", "n")).alias("counts"))
              .mapInPandas(number, "bin int, slice int, before long"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, b = (frame["rank"] + frame["before"]).to_numpy(), frame["bin"].to_numpy()
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int32)
            for k in np.unique(b):
                at = np.flatnonzero(b == k)
                row = places[int(k)]
                r = row[np.searchsorted(row[:, 0], rank[at], "right") - 1]
                sequence[at], slot[at] = r[:, 1] + rank[at] - r[:, 0], r[:, 2]
            yield frame.drop(columns=["rank", "before", "bin", "slice"]).assign(sequence_id=sequence, slot=slot)

    placed = pieces.join(before, ["slice", "bin"]).mapInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot int")
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot")
