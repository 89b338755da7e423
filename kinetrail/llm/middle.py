"""Fill-in-middle transformation by content-defined chunk memoization.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever it falls under
a bound, so a passage that many documents share is cut alike in each.  Of every
chunk a summary is kept: its tokens, its code points, and whether it begins and
ends with a letter.  A worker remembers summaries by the chunk's bytes (the
lookup compares them), so a shared chunk is read once.  The tokens of a document
are the sum over its chunks, less one wherever a run of letters crosses a border;
running sums find the chunk of a cut, and only that chunk is read token by token.

Nothing is shuffled: a document is one row, a batch holds ``BATCH_BYTES`` or one
text, and a worker remembers at most twice ``memory_bytes`` of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches, utf8

WINDOW = 16          # bytes under the rolling hash, a power of two
MEAN_CHUNK = 256     # bytes
_SLICE = 1 << 20     # bytes hashed at once
_LONGEST_KEPT = 4096
_MULTIPLIER = 0x9E3779B1
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)


def boundaries(raw: np.ndarray, ends: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Places where chunks begin, in the bytes of several texts; ``ends`` are the n+1 ends of the texts.

    A chunk never begins inside a UTF-8 character, nor within the first ``WINDOW``
    bytes of a text except at its start, so the cuts depend on one text alone.
    """
    found = []
    for at in range(0, len(raw), _SLICE):
        low = max(0, at - WINDOW + 1)
        h = _FACTORS[raw[low:at + _SLICE]]
        width, factor = 1, _MULTIPLIER
        while width < WINDOW:
            wider = h.copy()
            wider[width:] += h[:-width] * np.uint32(factor)
            h, width, factor = wider, 2 * width, factor * factor & 0xFFFFFFFF
        found.append(np.flatnonzero(h[at - low:] < np.uint32((1 << 32) // mean)) + at + 1)
    cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
    cuts = cuts[cuts < len(raw)]
    cuts = cuts[(raw[cuts] & 0xC0) != 0x80]
    own = ends[np.searchsorted(ends, cuts, side="right") - 1]
    firsts = ends[:-1][ends[1:] > ends[:-1]]
    return np.union1d(cuts[cuts - own >= WINDOW], firsts)


def _letters(b: np.ndarray) -> np.ndarray:
    return ((b | 0x20) - np.uint8(97)) < 26


def _token_starts(b: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a token, a code point begins at each byte, and whether it is a letter; ``firsts`` begin chunks."""
    letter = _letters(b)
    point = (b & 0xC0) != 0x80
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[firsts] = False
    return point & ~inside, point, letter


class Summaries:
    """Chunk bytes -> tokens << 35 | code points << 2 | begins << 1 | ends with a letter; bounded, in two generations."""

    def __init__(self, memory_bytes: int):
        self.memory_bytes, self.held = memory_bytes, 0
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def of(self, chunks: list[bytes]) -> np.ndarray:
        young, old = self.young, self.old
        got = [young.get(c) or old.get(c) or 0 for c in chunks]  # a chunk has a code point: never 0
        new = list(dict.fromkeys(c for c, v in zip(chunks, got) if not v))
        if new:
            made = dict(zip(new, self._read(new)))
            got = [v or made[c] for c, v in zip(chunks, got)]
            for c, v in made.items():
                if len(c) <= _LONGEST_KEPT:
                    young[c] = v
                    self.held += len(c)
            if self.held > self.memory_bytes:
                self.young, self.old, self.held = {}, young, 0
        return np.array(got, np.int64)

    @staticmethod
    def _read(chunks: list[bytes]) -> list[int]:
        size = np.array([len(c) for c in chunks], np.int64)
        firsts = np.cumsum(size) - size
        token, point, letter = _token_starts(np.frombuffer(b"".join(chunks), np.uint8), firsts)
        n, points = np.add.reduceat(token, firsts, dtype=np.int64), np.add.reduceat(point, firsts, dtype=np.int64)
        return (n << 35 | points << 2 | letter[firsts].astype(np.int64) << 1 | letter[firsts + size - 1]).tolist()


class Cutter:
    """Token counts and cuts of the texts of one batch."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, known: Summaries):
        self.raw, self.ends = raw, ends
        self.start = boundaries(raw, ends)
        self.stop = np.append(self.start[1:], len(raw)) if len(self.start) else self.start
        data = raw.tobytes()
        found = known.of([data[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist())])
        begins, letter = (found >> 1 & 1).astype(bool), (found & 1).astype(bool)
        self.crossed = np.zeros(len(found), bool)  # a run of letters reaches in from the chunk before
        self.crossed[1:] = begins[1:] & letter[:-1]
        self.crossed[np.isin(self.start, ends)] = False
        self.tokens = np.concatenate([[0], np.cumsum((found >> 35) - self.crossed)])
        self.points = np.concatenate([[0], np.cumsum(found >> 2 & 0x1FFFFFFFF)])
        self.first = np.searchsorted(self.start, ends)  # first chunk of each text
        self.n = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, text: int, k: int) -> tuple[int, int]:
        """(byte, code points of the text before it) after ``k`` tokens of a text."""
        first = self.first[text]
        if k == 0:
            return int(self.ends[text]), 0
        if k == self.n[text]:
            return int(self.ends[text + 1]), int(self.points[self.first[text + 1]] - self.points[first])
        goal = self.tokens[first] + k
        j = int(np.searchsorted(self.tokens, goal, side="right")) - 1
        b = self.raw[self.start[j]:self.stop[j]]
        token, point, _ = _token_starts(b, np.zeros(1, np.int64))
        token[0] &= not self.crossed[j]
        at = int(np.flatnonzero(token)[goal - self.tokens[j]])
        return int(self.start[j]) + at, int(self.points[j] - self.points[first]) + int(np.count_nonzero(point[:at]))


def fill_in_middle(docs: DataFrame, salt: str = "1:", transformed_pct: int = 90, spm_pct: int = 20,
                   memory_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    A text of n tokens (a run of A-Z and a-z, or one other code point) is cut in
    prefix, middle and suffix at two tokens drawn from the SHA-256 of ``salt`` and
    the id.  ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix,
    middle) or ``spm`` (suffix, prefix, middle), each part after its mark.

    A null text counts as empty, and an empty text is plain with n = 0; a null id
    is drawn as an id without digits; repeated rows are rows of their own with
    equal results; one that holds a mark stays plain; an empty table gives no
    rows.  Columns other than the id and the text play no part.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Summaries(memory_bytes)
        for batch in batches:
            cutter = Cutter(*utf8(batch, "text"), known)
            data, ends, counts = cutter.raw.tobytes(), cutter.ends.tolist(), cutter.n.tolist()
            form, prefix, middle, out = [], [], [], []
            for k, (h1, h2, h3, h4) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
                text, n = data[ends[k]:ends[k + 1]], counts[k]
                if not text or h3 % 100 >= transformed_pct or b"<P>" in text or b"<S>" in text or b"<M>" in text:
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    out.append(text)
                    continue
                (a, before), (b, upto) = (cutter.cut(k, x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
                p, m, s = data[ends[k]:a], data[a:b], data[b:ends[k + 1]]
                spm = h4 % 100 < spm_pct
                form.append("spm" if spm else "psm")
                prefix.append(before)
                middle.append(upto - before)
                out.append(b"".join((b"<S>", s, b"<P>", p, b"<M>", m) if spm else (b"<P>", p, b"<S>", s, b"<M>", m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), *drawn, F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of.  Marks are found exactly: no text that is cut holds one."""
    parts = F.split(output, "<[PSM]>", 4)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


SQL = """WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
      regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
  drawn AS (
    SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
          OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
        WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
  parts AS (
    SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p,
      coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
      coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM drawn)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
      WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM parts"""
