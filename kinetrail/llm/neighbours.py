"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Vectors are first collapsed to classes of equal (label, vector), so copies cost
one row.  Each class gets a sign code per table; classes that share a code of a
table are compared exactly, and links at or above the threshold become counts
per class and a few links that span what a task found connected (all pairs are
compared there, none is emitted).  A pair that already shared the code of an
earlier table is left to that table, so nothing is counted twice.

The code length follows the number of vectors of the largest label, and the
number of tables follows from it and from ``recall`` at exactly the threshold.
A code with more than ``tile`` classes is cut into tiles compared pairwise, so
no task holds more than two tiles of one code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import groups
from kinetrail.llm.components import connected_components
from kinetrail.plans.stage import written


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def tables_for(count: int, threshold: float, recall: float, per_code: int = 32) -> tuple[int, int]:
    """Bits of a code and number of tables."""
    bits = min(24, max(4, round(math.log2(max(count, 1) / per_code)) if count > per_code else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, all of length ``dim``, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of tiny and huge vectors in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, tile: int = 1024, seed: int = 11,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows with a null label, id or vector, a zero vector, or null or non-finite
    components link with nothing, and so do vectors of different lengths; such
    rows are kept.  Repeated rows link with each other; rows that share an id but not
    label and vector are vectors of their own; an empty table gives no rows; other
    columns are not read.
    """
    width = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(width).alias("v"),
                          F.col(label_col).alias("label"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & F.coalesce(
        F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = written(rows.filter("fit").groupBy("label", "v").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")).withColumn(
        "id", F.monotonically_increasing_id()), "classes")  # the written number names a class
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(most, threshold, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t["dim"].to_numpy()
            for dim in np.unique(dims):
                part = t.filter(pa.array(dims == dim)).combine_chunks()
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                on = (_unit(matrix(part["v"], int(dim))) @ planes > 0).reshape(-1, tables, bits)
                codes = (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                part = part.append_column("codes", pa.ListArray.from_arrays(
                    pa.array(np.arange(len(codes) + 1) * tables, pa.int32()), pa.array(codes.ravel())))
                yield from part.to_batches()

    kind = dict(classes.dtypes)["label"]
    coded = written(classes.drop("least").mapInArrow(
        code, f"label {kind}, v {width}, copies long, dim int, id long, codes array<int>"), "coded")
    key = ["label", "dim", "t", "code"]
    shared = coded.select("label", "dim", F.posexplode("codes").alias("t", "code")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("tiles", F.ceil(F.col("members") / tile).cast("int")).drop("members")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = (coded.select("*", F.posexplode("codes").alias("t", "code")).join(shared, key)
             .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("dim", "t", F.xxhash64(*key).alias("h"), "label", "code", F.least("own", "other").alias("p"),
                     F.greatest("own", "other").alias("q"), "own", "id", "copies",
                     F.slice("codes", 1, F.col("t")).alias("codes"), "v"))  # the codes of earlier tables
    # a tile meets itself once: rows with own = other appear once, others once per other tile
    group = ["label", "dim", "t", "code", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, group):
            dim, t, p, q = (g[c][0].as_py() for c in ("dim", "t", "p", "q"))
            g = g.combine_chunks()
            x, ids, copies, own_tile = _unit(matrix(g["v"], dim)), g["id"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
            codes = matrix(g["codes"], t)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if p != q:
                linked &= own_tile[:, None] != own_tile[None, :]
            i, j = np.nonzero(linked)
            for s in range(t):  # left to the earlier table
                seen = codes[i, s] == codes[j, s]
                linked[i[seen], j[seen]] = False
                i, j = i[~seen], j[~seen]
            if not len(i):
                continue
            label, before = np.arange(len(ids)), None
            while before is None or (label != before).any():
                before = label.copy()
                np.minimum.at(label, i, before[j])
                label = label[label]
            touched = np.unique(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[touched]), pa.array((linked @ copies)[touched].astype(np.int64)), pa.array(ids[label[touched]])],
                names=["id", "links", "other"])

    found = written(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        compare, "id long, links long, other long"), "linked")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    reached = component.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("reached"))
    known = classes.select("label", "v", "id", "copies", "least").join(counts, "id", "left").join(component, "id", "left").join(
        reached, "component", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("reached", "least").alias("component_id"))
    fitting = rows.filter("fit").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fitting.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
