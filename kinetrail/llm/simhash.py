"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``segments``.  If two differ in at most ``distance``
bits, then some segment differs in at most ``distance // segments`` of them
(one less for the later segments, by the pigeonhole rule).  Distinct
fingerprints enter one table per segment and probe it with the small Hamming
ball round their own segment; every match is verified over all 64 bits.

Equal fingerprints are one entry, so copies cost nothing.  A task compares the
probes and entries of one table key in tiles and emits links that span what it
found connected, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches
from kinetrail.llm.components import connected_components
from kinetrail.plans.stage import written

_TILE = 2048


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text, A-Z lowered."""
    from xxhash import xxh64_digest

    w = text.lower().split()  # of bytes: exactly A-Z, and exactly the blanks \x20 \x09-\x0D
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*[w[k:] for k in range(words)]))) or [b" ".join(w)]
    on = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 16384):
        raw = b"".join([xxh64_digest(s, seed) for s in shingles[start:start + 16384]])
        on += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(on * 2 > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", words, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       text_hash(F.col(text_col)).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def text_hash(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(text)


def representatives(groups: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the document of each group that stays: the least id, null last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w")
    return groups.groupBy("group").agg(least).select("w.doc_id", "w.text_hash")


def _balls(segments: int, distance: int) -> list[tuple[int, int, list[int]]]:
    """Per segment: its shift, its mask, and the non-zero flips to probe with."""
    radius, rest = divmod(distance, segments)
    cuts = [64 * k // segments for k in range(segments + 1)]
    out = []
    for k in range(segments):
        width = cuts[k + 1] - cuts[k]
        r = radius if k <= rest else radius - 1
        flips = [sum(1 << b for b in c) for n in range(1, r + 1) for c in combinations(range(width), n)]
        out.append((cuts[k], (1 << width) - 1, flips if r >= 0 else None))
    return out


def hamming_links(prints: DataFrame, distance: int, segments: int) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (a, b) that connect all within ``distance``."""
    balls = _balls(segments, distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (shift, mask, flips) in enumerate(balls):
                if flips is None:
                    continue
                own = (fp.view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)
                for flip in [0, *flips]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(fp), k, np.int32)), pa.array((own ^ np.uint64(flip)).view(np.int64)),
                        pa.array(np.full(len(fp), flip != 0)), pa.array(fp)], names=["seg", "key", "probe", "fp"])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[:, None].view(np.uint64) ^ b[None, :].view(np.uint64)) <= distance

    def in_key(entries: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
        label = np.arange(len(entries))
        if len(entries) > 1:
            while True:  # entries of one key are connected in place
                before = label.copy()
                for x in range(0, len(entries), _TILE):
                    for y in range(0, len(entries), _TILE):
                        m = near(entries[x:x + _TILE], entries[y:y + _TILE])
                        best = np.where(m, label[None, y:y + _TILE], len(entries)).min(axis=1)
                        label[x:x + _TILE] = np.minimum(label[x:x + _TILE], best)
                label = label[label]
                if (label == before).all():
                    break
        links = [(int(entries[i]), int(entries[label[i]])) for i in np.flatnonzero(label != np.arange(len(label)))]
        roots = np.unique(label)
        for x in range(0, len(probes), _TILE):
            part = probes[x:x + _TILE]
            for y in range(0, len(entries), _TILE):
                i, j = np.nonzero(near(part, entries[y:y + _TILE]))
                if len(i):
                    pairs = np.unique(np.stack([i, np.searchsorted(roots, label[y + j])]), axis=1)
                    links += [(int(part[p]), int(entries[roots[r]])) for p, r in pairs.T]
        return links

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def solve(rows: list[np.ndarray], upto: int) -> pa.RecordBatch:
            seg, key, probe, fp = (r[:upto] for r in rows)
            starts = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])]) if upto else np.zeros(0, int)
            ends = np.r_[starts[1:], upto]
            links: list[tuple[int, int]] = []
            some = np.flatnonzero((ends - starts > 1) & (probe[starts] == 0)) if upto else starts
            for s, e in zip(starts[some].tolist(), ends[some].tolist()):
                p = s + int(np.searchsorted(probe[s:e], 1))
                links += in_key(fp[s:p], fp[p:e])
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            held = [np.concatenate(p) for p in zip(held, new)]
            if len(held[0]) >= 1 << 16:
                seg, key = held[0], held[1]
                differs = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1]))
                if len(differs):
                    cut = int(differs[-1]) + 1
                    yield solve(held, cut)
                    held = [h[cut:] for h in held]
        yield solve(held, len(held[0]))

    return prints.select("fp").mapInArrow(spread, "seg int, key long, probe boolean, fp long").repartition(
        "seg", "key").sortWithinPartitions("seg", "key", "probe").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, segments: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, text_hash, group) of every row; ``group`` names the component by a fingerprint.

    Null, empty and blank texts have fingerprint 0 and link like any other;
    repeated rows are rows of the same component; a null id never names a
    component unless no other id reaches it (then it is null); an empty table
    gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(hamming_links(distinct, distance, segments))
    placed = distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return prints.join(named.select("fp", "component_id", F.col("component").alias("group")), "fp").select(
        "doc_id", "fp", "component_id", "text_hash", "group")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
