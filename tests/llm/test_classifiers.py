"""The trained networks: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from kinetrail.llm import langid, quality
from kinetrail.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def pieces(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def numeric(loss, w, key, at, eps):
    old = w[key][at]
    w[key][at] = old + eps
    up = loss()
    w[key][at] = old - eps
    down = loss()
    w[key][at] = old
    return (up - down) / (2 * eps)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, int(n)).tolist()) for n in (5, 130, 400, 900)]
    y, weight = np.array([0, 1, 1, 0], np.float32), np.array([1, 2, 1, 1], np.float32)
    w = {k: v.astype(np.float64) for k, v in quality.fit(texts, y, weight, passes=2).items()}

    def loss():
        x, first = quality.blocks_of(*pieces(texts))
        best = quality._windows(x, w, 0, first[-1]).max(axis=1)
        p = quality._head(quality._pooled(best, first)[0], first, quality._fill(x, first), w)[-1]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y))

    g = quality._gradients(*pieces(texts), y, weight, w)
    for key in w:
        for at in [tuple(int(rng.integers(0, s)) for s in w[key].shape) for _ in range(4)]:
            if key == "embed":
                at = (100, at[1])
            assert g[key][at] == pytest.approx(numeric(loss, w, key, at, 1e-6), rel=2e-2, abs=2e-5)


def test_language_gradients():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 110, (6, langid.CHUNK)).astype(np.int16)
    x[2, 50:] = langid.PAD
    y = np.array([0, 1, 2, 0, 1, 2])
    w = {k: v.astype(np.float64) * 0.5 for k, v in langid.fit([b""], np.zeros(1, int), 3).items()}

    def loss():
        p = langid._positions(langid._scan(x, w, "f", False), langid._scan(x, w, "b", False), w)
        mask = (x != langid.PAD).T
        return float(-(np.log(p[:, np.arange(6), y]) * mask).sum() / mask.sum())

    g = langid._gradients(x, y, w)
    for key in w:
        for at in [tuple(int(rng.integers(0, s)) for s in w[key].shape) for _ in range(3)]:
            if key.startswith("in_"):
                at = (100, at[1])
            assert g[key][at] == pytest.approx(numeric(loss, w, key, at, 1e-2), rel=3e-2, abs=2e-5)


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(2)
    w = quality.fit([b"ab" * 50, b"xy" * 50], np.array([0, 1], np.float32), np.ones(2, np.float32), passes=3)
    long = bytes(rng.integers(32, 126, 300_000).tolist())
    one = quality.scores(*pieces([long]), w)
    assert quality.scores(*pieces([b"", long, b"q"]), w)[1] == one[0]
    changed = long[:-20] + b"~" * 20
    assert quality.scores(*pieces([changed]), w)[0] != one[0]


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    got = QUERIES["op2_quality"](spark, D).collect()
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    wins = [(a > b) + (a == b) / 2 for a, x in held if x == 1 for b, y in held if y == 0]
    assert np.mean(wins) > 0.9


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = QUERIES["op9_language"](spark, D).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_odd_rows(spark):
    rows = [(0, None, None), (1, "", "en"), (2, "123 !?", "en"), (3, "a", None), (4, "the cat " * 30000, "en"), (5, "der hund", "de"),
            (5, "der hund", "de"), (None, "und so", "de"), (7, "漢字", None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, score string, label int")
    languages, w = langid.train(docs)
    got = sorted(langid.predict(docs, languages, w).collect(), key=str)
    assert len(got) == len(rows) and languages == ["de", "en"]
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2} and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    q = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(q) == len(rows) and all(0 <= r.score <= 1 for r in q)
    empty = docs.limit(0)
    assert langid.predict(empty, *langid.train(empty)).count() == 0
    assert quality.score_quality(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_sample_takes_one_row_of_an_id(spark):
    """A third of all rows on one labelled id: the sample stays within twice its number of ids."""
    from pyspark.sql import functions as F

    from kinetrail.llm.common import bounded_sample

    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("doc_id"),
                                    F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    found = bounded_sample(docs, labels, 20, 1)
    assert 0 < len(found) <= 80 and len({f[0] for f in found}) == len(found)
    everything = bounded_sample(docs, labels, 5000, 1)
    assert len(everything) == 2001 and ("text 00000", 0, 1001) in everything
