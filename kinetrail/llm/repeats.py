"""Removal of every byte in a string of ``length`` bytes that starts twice anywhere.

*Deal.*  Each window of ``length`` bytes is named by its least ``SEED``-byte
string (least by hash, then leftmost).  The name depends on the window's bytes
alone, so equal windows have equal names, and neighbouring windows share the
place of their name, so a text becomes runs of windows, about one per hundred
bytes.  Names that occur once in the corpus end there; the others are rare, and
only their runs go on.

*Equal runs* (same name, length and hash) are counted by partial aggregates: a
passage copied a thousand times is one row, and all its windows are repeated.

*Different runs of one name* may share some windows.  Their bytes, one
representative each, are dealt by name; a task joins many of them into one text
and finds its repeated windows on the Burrows-Wheeler transform: common prefixes
of neighbouring suffixes are found by increasing value, breadth first, by
extending intervals backwards, and the expansion stops at ``length``; suffixes
whose common prefix was not reached by then share ``length`` bytes.

A name with more than ``most`` different runs would be one large task, so its
windows are dealt one by one, by a 128-bit hash of their bytes, and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches, utf8
from kinetrail.plans.stage import written

SEED = 48
_SLICE = 1 << 18  # bytes hashed at once
_TEXT = 1 << 18  # bytes of one transform


# ------------------------------------------------------------ naming runs ---


class Hashes:
    """Polynomial hashes modulo 2^64 over random byte values, by prefix sums."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.power = np.cumprod(np.full(size + 1, base, np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.full(size + 1, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.value[x] * self.power[:len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((prefix[stop] - prefix[start]) * self.inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_HASHES: dict[tuple[int, int], Hashes] = {}


def _hashes(size: int, seed: int = 1) -> Hashes:
    if (size, seed) not in _HASHES:
        _HASHES[size, seed] = Hashes(size, seed)
    return _HASHES[size, seed]


def windows_of(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and first byte of every window of texts laid end to end."""
    sizes = np.maximum(np.diff(ends) - length + 1, 0)
    begin = np.repeat(ends[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(sizes)), sizes), begin


def runs_of(x: np.ndarray, ends: np.ndarray, length: int, seed_bytes: int = SEED) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, name, hash) of the runs of texts laid end to end."""
    if len(x) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = _hashes(_SLICE + length)
    prefix = hashes.prefix(x)
    named = mixed((prefix[seed_bytes:] - prefix[:-seed_bytes]) * hashes.inverse[:len(x) - seed_bytes + 1])
    place_bits = np.uint64(int(len(x)).bit_length())
    place_mask = (np.uint64(1) << place_bits) - np.uint64(1)
    least = (named & ~place_mask) | np.arange(len(named), dtype=np.uint64)
    width, span = length - seed_bytes + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[:-(width - span)], least[width - span:])
    text, begin = windows_of(ends, length)
    least = least[begin]
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) if len(least) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(least)])
    start = begin[first]
    content = hashes.spans(prefix, start, start + count + length - 1)
    name = named[(least[first] & place_mask).astype(np.int64)]
    return text[first], start - ends[text[first]], count, name.view(np.int64), content.view(np.int64)


def _sliced(raw: np.ndarray, ends: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts in slices of bounded bytes; a longer text in overlapping parts.

    Yields bytes, ends, the number of each text, and where its part begins."""
    k, n = 0, len(ends) - 1
    while k < n:
        size = ends[k + 1] - ends[k]
        if size > _SLICE:
            for a in range(0, size - overlap, _SLICE - overlap):
                part = raw[ends[k] + a:min(ends[k] + a + _SLICE, ends[k + 1])]
                yield part, np.array([0, len(part)]), np.array([k]), np.array([a])
            k += 1
            continue
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + _SLICE, "right")) - 1)
        yield raw[ends[k]:ends[stop]], ends[k:stop + 1] - ends[k], np.arange(k, stop), np.zeros(stop - k, np.int64)
        k = stop


# ------------------------------------------- the Burrows-Wheeler transform ---


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and their ranks, by doubling; only undecided groups are sorted again."""
    n = len(codes)
    bits = int(codes.max() + 1).bit_length()
    span = 62 // bits
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(span, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(span):
        key = (key << bits) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    leads = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(leads, np.arange(n), 0))
    while True:
        at = np.flatnonzero(~leads | np.r_[~leads[1:], False])
        if not len(at):
            return order, rank
        key = (rank[order[at]] << 32) | rank[np.minimum(order[at] + span, n - 1)]
        by = np.argsort(key, kind="stable")
        order[at] = order[at][by]
        key = key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        leads[at] |= new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        span *= 2


def deep_neighbours(codes: np.ndarray, separators: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, and whether each shares ``length`` symbols with the one before.

    Symbols below ``separators`` occur once each and end the strings.  A row whose
    common prefix with the row before has value v is a border of value v.  In the
    interval that begins at a border, the first row before which a symbol stands
    is, one symbol longer, a border of value v + 1, unless it has a smaller one:
    so borders are found by increasing value, each once, up to length - 1.
    """
    n = len(codes)
    order, rank = suffix_order(codes)
    before = np.where(order > 0, order - 1, n - 1)
    transform, back = codes[before], rank[before]
    extends = transform >= separators
    by = np.argsort(transform, kind="stable")
    earlier = np.full(n, -1, np.int64)  # the row above with the same symbol
    earlier[by[1:]] = np.where(transform[by][1:] == transform[by][:-1], by[:-1], -1)
    border = np.zeros(n + 1, bool)
    border[n] = True
    lead = codes[order]
    front = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
    border[front] = True
    for _ in range(1, length):
        if not len(front):
            break
        borders = np.flatnonzero(border)
        size = borders[np.searchsorted(borders, front, "right")] - front
        row = np.repeat(front - np.cumsum(size) + size, size) + np.arange(size.sum())
        row = row[extends[row] & (earlier[row] < np.repeat(front, size))]
        to = back[row]
        front = np.unique(to[~border[to]])
        border[front] = True
    return order, ~border[:n]


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows start more than once among all strings."""
    m = len(strings)
    codes = np.empty(sum(map(len, strings)) + m, np.int64)
    at, places = 0, []
    for k, s in enumerate(strings):
        codes[at:at + len(s)] = np.frombuffer(s, np.uint8)
        codes[at:at + len(s)] += m
        codes[at + len(s)] = k
        places.append(at)
        at += len(s) + 1
    order, deep = deep_neighbours(codes, m, length)
    flag = np.zeros(len(codes), bool)
    flag[order[deep | np.r_[deep[1:], False]]] = True
    return [flag[p:p + max(0, len(s) - length + 1)] for p, s in zip(places, strings)]


# ------------------------------------------------------------- the operator ---


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge[::2], edge[1::2]


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array of (start, stop), kept binary) of every row.

    Texts are UTF-8 bytes and matches never cross rows.  A null or empty text has
    no bytes; texts under ``length`` bytes keep all; repeated rows repeat each
    other, so their long strings go everywhere; a null id is an id like others;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # equal rows share a key: each repeats the other, and the spans of one are those of the other
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for x, ends, number, begins in _sliced(*utf8(batch, "text"), length - 1):
                text, start, count, name, content = runs_of(x, ends, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(name), pa.array(content), pa.array(keys[number[text]]), pa.array(start + begins[text]),
                    pa.array(count.astype(np.int32))], names=["name", "content", "key", "start", "windows"])

    runs = keyed.select("key", "text").mapInArrow(find, "name long, content long, key long, start long, windows int")
    names = runs.groupBy("name").count().filter("count > 1").select("name")
    again = written(runs.join(names, "name", "left_semi"), "runs")
    alike = ["name", "content", "windows"]
    kinds = written(again.groupBy(*alike).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start")).alias("first")), "kinds")
    copied = again.join(kinds.filter("copies > 1").select(*alike), alike, "left_semi").select(
        "key", "start", (F.col("start") + F.col("windows") + length - 1).alias("stop")).distinct()  # equal rows share spans

    several = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(several, "name").groupBy("first.key").agg(F.collect_list(F.struct(
        "name", "kinds", "first.start", "windows", (F.col("copies") > 1).alias("copied"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "kinds", "key", "start", "copied", "body"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in batches:
            rows = []
            for key, text, want in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = (text or "").encode()
                rows += [(w["name"], w["kinds"], key, w["start"], w["copied"], raw[w["start"]:w["start"] + w["windows"] + length - 1])
                         for w in want]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    bodies = written(keyed.select("key", "text").join(wanted, "key").mapInArrow(
        cut, "name long, kinds long, key long, start long, copied boolean, body binary"), "bodies")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bodies sorted by name: whole names, joined to texts of about ``_TEXT`` bytes."""
        held, size = [], 0

        def solve(rows: list) -> pa.RecordBatch:
            out = ([], [], [])
            flags = repeated_windows([r[3] for r in rows], length) if rows else []
            for (_, key, start, _, done), flag in zip(rows, flags):
                if not done:
                    for a, b in zip(*_stretches(flag)):
                        out[0].append(key)
                        out[1].append(start + int(a))
                        out[2].append(start + int(b) + length - 1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "start", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held and row[:3] == held[-1][:3]:  # the same body of an equal row
                    continue
                if size > _TEXT and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield solve(held)

    few = bodies.filter(F.col("kinds") <= most).select("name", "key", "start", "body", "copied").repartition(
        "name").sortWithinPartitions("name", "key", "start").mapInArrow(transform, "key long, start long, stop long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, begin = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            copied = batch.column(3).to_numpy(zero_copy_only=False)
            for x, ends, number, begins in _sliced(*utf8(batch, "body"), length - 1):
                text, at = windows_of(ends, length)
                pair = [(h := _hashes(_SLICE + length, s)).spans(h.prefix(x), at, at + length).view(np.int64) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[0]), pa.array(pair[1]), pa.array(key[number[text]]),
                     pa.array(begin[number[text]] + begins[text] + at - ends[text]), pa.array(copied[number[text]])],
                    names=["h1", "h2", "key", "start", "copied"])

    # representatives are one per kind, so a window twice among them starts twice in the corpus
    dealt = bodies.filter(F.col("kinds") > most).select("key", "start", "body", "copied").mapInArrow(
        windows, "h1 long, h2 long, key long, start long, copied boolean")
    twice = dealt.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    many = dealt.join(twice, ["h1", "h2"], "left_semi").filter("not copied").select(
        "key", "start", (F.col("start") + length).alias("stop"))

    spans = copied.unionAll(few).unionAll(many).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            raw, ends = utf8(batch, "text")
            covered = batch.column(2)
            sizes, spans_out, kept = np.diff(ends), [], []
            for k in range(batch.num_rows):
                text = raw[ends[k]:ends[k + 1]]
                if not covered[k].is_valid:
                    spans_out.append([])
                    kept.append(text.tobytes())
                    continue
                parts = covered[k].values
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, parts.field(0).to_numpy(), 1)
                np.add.at(change, parts.field(1).to_numpy(), -1)
                gone = np.cumsum(change[:-1]) > 0
                spans_out.append([{"start": int(a), "stop": int(b)} for a, b in zip(*_stretches(gone))])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(spans_out, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return keyed.join(spans, "key", "left").select("doc_id", "text", "covered").mapInArrow(
        apply, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
