"""Mixing against apportionment seat by seat and the targets of the contract."""

import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import mixing


@pytest.mark.parametrize("seed", range(6))
def test_seats_go_to_the_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    weights = [int(w) for w in rng.integers(0, 10 ** int(rng.integers(1, 6)), 12)] + [0, 7, 7]
    seats = int(rng.integers(0, 400))
    plain = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda k: (Fraction(weights[k], 2 * plain[k] + 1), -k))
        plain[best] += 1
    assert mixing.sainte_lague(weights, seats) == plain


def test_targets_stop_at_twice_the_size():
    sizes = [10, 1000, 5, 0, 300]
    t = mixing.fill_targets(sizes, [5, 2, 1, 5, 2], Fraction(3, 2), 2)
    assert sum(t) == Fraction(3, 2) * sum(sizes) and all(x <= 2 * s for x, s in zip(t, sizes))
    open_ = [k for k in range(5) if t[k] < 2 * sizes[k]]
    assert len({t[k] / [5, 2, 1, 5, 2][k] for k in open_}) <= 1


def test_mix(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t", "a", "x y z\x0bq\r\n", *["w " * int(n) for n in rng.integers(0, 900, 300)]]
    rows = [(i, t, ["b", "a", None, "é"][min(3, int(rng.integers(0, 9)))], "clash") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "one two", "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    kw = dict(shard_words=20_000, shard_docs=64, block=16)
    got = mixing.mix(docs, **kw).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), **kw).collect()))
    assert len(got) == len(rows)
    sizes = {r.doc_id: r["size"] for r in got}
    by_source = {}
    for i, t, s, _ in rows:
        assert sizes[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = mixing.fill_targets([sum(r["size"] for r in by_source[s]) for s in order],
                               [mixing.WEIGHTS[k % 3] for k in range(len(order))], Fraction(3, 2), 2)
    for s, t in zip(order, want):
        assert {r.target for r in by_source[s]} == {float(t)}
        assert {r.source_size for r in by_source[s]} == {sum(r["size"] for r in by_source[s])}
        assert abs(sum(r.taken for r in by_source[s]) - t) <= 16 * 8
    assert mixing.mix(spark.createDataFrame([], docs.schema)).count() == 0


def test_a_small_source_in_a_large_corpus_meets_its_target(spark):
    rows = [(i, "ten words " * 5, "small") for i in range(60)] + [(i, "w " * (i % 23), "zbig") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for weights in ((5, 2), (1, 20), (1, 100)):
        taken, target = {}, {}
        for r in mixing.mix(docs, weights=weights, shard_docs=64).collect():
            assert 0 <= r.taken <= 2 * r["size"]
            taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        # half a block by the source's seats, and a word a shard
        assert abs(taken["small"] - target["small"]) <= 17 and abs(taken["zbig"] - target["zbig"]) <= 16 + 94



def test_rows_of_one_id_are_spread(spark):
    rows = [(None, "the same text", "a")] * 3000 + [(None, f"text {i}", "a") for i in range(1000)] + [(None, None, "b")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"), F.xxhash64("text").alias("_row"))
    dealt = mixing._dealt(sized, 1 << 21, 64).collect()
    assert sum(r._copies for r in dealt) == len(rows) and max(r._copies for r in dealt) <= 8
    assert {r._row for r in dealt} == {r._row for r in sized.collect()}
    got = sorted(map(str, mixing.mix(docs, shard_docs=64, keep=("text",)).collect()))
    assert len(got) == len(rows) and got == sorted(map(str, mixing.mix(docs.repartition(7), shard_docs=64, keep=("text",)).collect()))
    plan = mixing.mix(docs, shard_docs=64)
    assert sum(r.taken for r in plan.collect() if r.source == "a") == pytest.approx(plan.filter("source = 'a'").first().target, abs=16 + 64)
