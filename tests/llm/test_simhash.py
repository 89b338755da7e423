"""SimHash groups against comparing every pair."""

import random

import numpy as np
import xxhash

from kinetrail.llm import components, simhash


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)]
    pairs += [(1000, k) for k in range(1001, 1200)] + [(7, 7), (5000, 5000)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = plain_components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != 5000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_all_within_the_distance(spark):
    rng = np.random.default_rng(0)
    prints = set()
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(4):
            prints.add(x)
            x ^= sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(1, 5)))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    for distance, segments in ((2, 2), (3, 2), (3, 4), (0, 2)):
        links = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance]
        want = plain_components(signed, links)
        got = [(r.a, r.b) for r in simhash.hamming_links(df, distance, segments).collect()]
        assert plain_components(signed, got) == want


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "XYZWVU"]
    texts = [None, "", " \t\x0b", "One", "one", "Two words", "two\nwords", "É A b c", "É a B C"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([4, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, "One", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)
    got = simhash.near_duplicates(docs).collect()
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = plain_components(prints, links)
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(spark.createDataFrame([], docs.schema)).count() == 0
