"""Top products against computing all of them."""

import math

import numpy as np
import pytest

from kinetrail.llm import topk


def plain(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in ok if i != q and len(u) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("page,per_pivot", [(8192, 4096), (40, 60)])
def test_top_products(spark, page, per_pivot):
    rng = np.random.default_rng(page)
    rows = [(0, None, 1), (50, [0.5] * 7 + [None], 1), (100, [float("nan")] * 8, 1), (150, [0.25] * 8, 1), (200, [], 1), (250, [1.0] * 3, 1),
            (None, [9.0] * 8, 1), (251, [0.5] * 3, 1), (300, [0.0] * 8, 1)]
    centers = rng.standard_normal((6, 8))
    for n in range(400, 1400):
        rows.append((n, (centers[n % 6] * rng.choice([0.1, 1.0]) + 0.2 * rng.standard_normal(8)).tolist(), 1))
    rows += [(n, [0.3] * 8, 1) for n in range(2000, 2200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int").repartition(5)
    got = sorted(map(tuple, topk.top_products(df, page=page, per_pivot=per_pivot).collect()))
    assert got == plain(rows)
    assert topk.top_products(df.limit(0)).count() == 0
    few = df.filter("vec_id in (150, 400, 401)")
    assert sorted(map(tuple, topk.top_products(few).collect())) == plain([r for r in rows if r[0] in (150, 400, 401)])


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(n, (rng.standard_normal(4) * 1e6).tolist()) for n in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_products(df).collect())) == plain(rows)


def test_rows_that_share_an_id(spark):
    """Every row of a query's id asks for itself and is a candidate of the others."""
    rows = [(50, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [-1.0, 2.0]), (51, [0.25, 0.25]), (51, [0.5, 0.25]), (52, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [[math.floor(256 * x) for x in v] for _, v in rows]
    want = []
    for a, (q, _) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), i) for b, (i, _) in enumerate(rows) if b != a)[:3]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, topk.top_products(df, k=3).collect())) == sorted(want)


def test_a_third_of_rows_on_one_id(spark):
    rows = [(100 if n % 3 == 0 else n, [float(n % 7), float(n % 11)]) for n in range(1, 601)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(df, k=2, page=50, per_pivot=40).groupBy("query_id").count().collect()
    asked = [i for i, _ in rows if i % 50 == 0]
    assert {r.query_id: r["count"] for r in got} == {i: 2 * asked.count(i) for i in asked}
