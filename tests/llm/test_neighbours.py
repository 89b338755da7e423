"""Near vectors against comparing every pair."""

import math

import numpy as np
import pytest

from kinetrail.llm import neighbours
from test_simhash import plain_components


def plain(rows, threshold=0.98):
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            u, v = np.array(ok[a][1], float), np.array(ok[b][1], float)
            if ok[a][2] == ok[b][2] and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                links.append((ok[a][0], ok[b][0]))
    comp = plain_components([r[0] for r in rows], links)
    n = {r[0]: sum(r[0] in p for p in links) for r in rows}
    return {r[0]: (n[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(2)
    rows = [(0, None, 1, 5), (1, [0.0] * 16, 1, 5), (2, [1.0] * 15 + [None], 1, 5), (3, [float("nan")] * 16, 1, 5),
            (4, [float("inf")] + [1.0] * 15, 1, 5), (5, [1.0] * 16, None, 5), (6, [1.0] * 16, None, 5), (7, [], 1, 5), (8, [1.0] * 8, 1, 5)]
    n = 10
    for label in (1, 2):
        for _ in range(40):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, (base + rng.standard_normal(16) * 0.12 * rng.random()).tolist(), label, n))
                n += 1
    hot = rng.standard_normal(16)
    for k in range(40):
        rows.append((n, (hot * (1 + k % 3)).tolist() if k % 2 else (hot + 0.05 * rng.standard_normal(16)).tolist(), 2, n))
        n += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, dim int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(df, tile=tile).collect()}
    assert got == plain(rows)
    assert neighbours.near_vectors(spark.createDataFrame([], df.schema)).count() == 0


def test_given_table_recall(spark):
    from kinetrail.llm.common import table

    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(df).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rows_that_share_an_id(spark, kind):
    """Links belong to rows: a row of the same id with another vector or label has its own."""
    e1, near, e2 = [1.0] + [0.0] * 7, [1.0, 0.0625] + [0.0] * 6, [0.0, 1.0] + [0.0] * 6
    rows = [(1, e1, 1), (1, e2, 1), (1, e1, 2), (2, near, 1), (2, near, 1), (3, e2, 2)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_a_third_of_rows_on_one_id(spark):
    rng = np.random.default_rng(4)
    rows = [(7 if n % 3 == 0 else 1000 + n, rng.standard_normal(8).tolist(), n % 2) for n in range(300)]
    rows += [(r[0] + 5000, r[1], r[2]) for r in rows[:90]]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.vec_id in (5007, *range(6000, 6090))} <= {7, *range(1000, 1090)}
    assert sum(r.n_links for r in got) >= 180
