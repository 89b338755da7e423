"""The prefix trie against sequences kept in a dictionary."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import trie


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, d == len(turns)))
    out = []
    for path, m in members.items():
        under = [p for p in members if p[:len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c, end in m if end)
        out.append((
            min(c for c, _ in m), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(m),
            sum(p[:-1] == path for p in members if p), sum(p not in inner for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    rng = random.Random(11)
    rows = []
    for c in [*range(-7, 60), 100, 101, 5000, 5001, 5005, 9_000, 13_000]:
        start = [("user", rng.choice("ab")) for _ in range(rng.randrange(0, 4))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(start + [("assistant", rng.choice("xyé") * rng.randrange(4)) for _ in range(rng.randrange(0, 12))])]
    rows += [(200 + k, j, "user", f"equal {j}") for k in range(12) for j in range(14)]      # one very common conversation
    rows += [(300, k, "user", "again") for k in range(150)] + [(301, k, "user", "again") for k in range(90)]  # a deep chain
    rows += [(400, None, None, None), (400, 1, "user", None), (400, 1, None, "tie"), (400, 1, "a", "tie"), (400, 1, "a", "tie"), (None, 1, "user", "nobody")]
    rows += [(402, 0, "user", "one"), (403, 0, "user", "one")]   # may be left without turns
    return rows


def found(spark, rows, limit):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("rep", F.lit(1))
    made = trie.prefix_trie(trie.rebuild(trie.series(df.repartition(4))), limit)
    out = made.nodes.join(trie.ends_digest(made.ends), ["rep", "depth"], "left").select(
        "rep", "depth", "parent_rep", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("limit", [50_000, 120])
def test_trie(small_blocks, limit):
    rows = rows_of()
    assert found(small_blocks, rows, limit) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(None, 1, "a", "b")], 10) == []
    one = [(8, 1, "a", "bc")]
    assert found(spark, one, 10) == plain(one)


def test_centroids_of_forests_against_a_walk():
    rng = np.random.default_rng(2)
    for shape in ("random", "chain", "star", "caterpillar"):
        parts, want = [], []
        for tree in range(6):
            n = int(rng.integers(1, 60))
            up = [-1] + [{"random": int(rng.integers(0, k)), "chain": k - 1, "star": 0, "caterpillar": max(0, k - 1 - k % 2)}[shape] for k in range(1, n)]
            depth = [0] * n
            for k in range(1, n):
                depth[k] = depth[up[k]] + 1
            weight, leaves, saved = (rng.integers(1, 9, n) for _ in range(3))
            below, sl, ss = weight.copy(), leaves.copy(), saved.copy()
            for k in range(n - 1, 0, -1):
                for x in (below, sl, ss):
                    x[up[k]] += x[k]
            rep = np.arange(n) + 1000 * tree
            parts.append({"rep": rep, "depth": np.array(depth) + tree, "parent_rep": np.array([rep[u] if u >= 0 else 5 for u in up]),
                          "n_convs": weight, "below": below, "leaves": leaves, "saved": saved,
                          "top_rep": np.full(n, rep[0]), "top_depth": np.full(n, tree)})
            p = rng.permutation(n)
            parts[-1] = {k: v[p] for k, v in parts[-1].items()}
            want.append((sl[p], ss[p]))
        t = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}
        got = trie.centroid_sums(t)
        assert (got[0] == np.concatenate([w[0] for w in want])).all() and (got[1] == np.concatenate([w[1] for w in want])).all()


def test_ids_of_a_node_are_digested_in_blocks(spark):
    ids = [*range(-3, 9_000, 2), *range(10**12, 10**12 + 5)]
    ends = spark.createDataFrame([(c, 1, 2) for c in ids] + [(77, 5, 2)], "conv_id long, rep long, depth long").repartition(3)
    got = {(r.rep, r.depth): r.ends_sha256 for r in trie.ends_digest(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (5, 2): hashlib.sha256(b"77").hexdigest()}
