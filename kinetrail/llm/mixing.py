"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are the unit.  Sources, ordered by code point with null last, weigh 5, 2,
1, repeating; together they get ``share`` of all words, no source more than
``repeats`` times its own.  The words of a target are cut into blocks of ``block`` words, and
whole blocks are apportioned to the sources by highest quotients
``weight / (2 seats + 1)``.  The words of a source's blocks are apportioned to its
shards in the same way, a word a seat, so that shards hold integer quotas that add
up and ask no shard for what it does not have.  In a shard the documents lie end
to end in seeded order; a seeded permutation picks the blocks, and the last one
picked gives its first words where a quota ends inside it.

A source has its own number of shards, of about ``shard_words`` words and
``shard_docs`` documents, so a hot source becomes many and a small one stays whole.
A row's shard follows from all it holds, and a row repeated very often is dealt in
pieces.  Only one row per source reaches the driver: the sources are the
configuration of a mix, and weights are given to each.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.stage import written

WEIGHTS = (5, 2, 1)
_BLANK = "[\\x20\\x09-\\x0D]+"
COPIED_SOURCES = 20_000
FAN = 1024  # shards under one parent in the apportionment


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    pieces = F.split(text, _BLANK)
    edges = (F.element_at(pieces, 1) == "").cast("long") + (
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("long")
    return F.coalesce(F.size(pieces).cast("long") - edges, F.lit(0).cast("long"))


def fill_targets(sizes: list[int], weights: list[int], share: Fraction, repeats: int) -> list[Fraction]:
    """Shares by weight, capped at ``repeats`` times the size, the excess reshared."""
    total = share * sum(sizes)
    capped = [False] * len(sizes)
    target = [Fraction(0)] * len(sizes)
    while True:
        rest = total - sum(repeats * s for s, c in zip(sizes, capped) if c)
        open_weight = sum(w for w, c in zip(weights, capped) if not c)
        if not open_weight:
            return [Fraction(repeats * s) for s in sizes]
        target = [Fraction(repeats * s) if c else rest * w / open_weight for s, w, c in zip(sizes, weights, capped)]
        over = [k for k, (t, s) in enumerate(zip(target, sizes)) if not capped[k] and t > repeats * s]
        if not over:
            return target
        for k in over:
            capped[k] = True


def sainte_lague(weights: list, seats: int) -> list[int]:
    """Integer seats by highest quotients ``weight / (2 seats + 1)``; ties to the earlier."""
    total = sum(weights)
    if not total or not seats:
        return [0] * len(weights)
    # every party ends with at least this many: seats = round(w / d) and total / d >= seats - parties / 2
    got = [max(0, int((w * (2 * seats - len(weights)) - total) // (2 * total))) for w in weights]
    heap = [(-Fraction(w, 2 * g + 1), k) for k, (w, g) in enumerate(zip(weights, got)) if w]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, k = heap[0]
        got[k] += 1
        heapq.heapreplace(heap, (-Fraction(weights[k], 2 * got[k] + 1), k))
    return got


def _divide(children: DataFrame, by: str) -> DataFrame:
    """Seats of a parent shared among its children by their words."""

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(by)
        return pd.DataFrame({"_source": frame["_source"], by: frame[by], "seats": sainte_lague(
            [int(w) for w in frame["words"]], int(frame["parent_seats"].iloc[0]))})

    keys = ["_source"] if by == "_group" else ["_source", "_group"]
    return children.withColumn("_group", F.floor(F.col(by) / FAN) if by == "_shard" else F.col("_group")).groupBy(
        *keys).applyInPandas(share, f"_source long, {by} long, seats long")


def _dealt(sized: DataFrame, shard_words: int, shard_docs: int) -> DataFrame:
    """The rows with ``_copies`` and ``_piece``: equal rows beyond an eighth of a shard become one row for each eighth."""
    words, limit = max(1, shard_words // 8), max(1, shard_docs // 8)
    one = sized.withColumns({"_copies": F.lit(1).cast("long"), "_piece": F.lit(0).cast("long")})
    hot = written(sized.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).filter(
        (F.col("n") > limit) | ((F.col("n") > 1) & (F.col("words") > words))).select("_row"), "hot")
    many = hot.count()
    if not many:
        return one
    hot = F.broadcast(hot) if many <= COPIED_SOURCES else hot
    counted = sized.join(hot, "_row", "left_semi").groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    each = F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(words / F.greatest("size", F.lit(1))))).cast("long")
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / each))))
    copies = F.least(each, F.col("_n") - F.col("_piece") * each)
    return one.join(hot, "_row", "left_anti").unionByName(pieces.withColumn("_copies", copies).drop("_n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), repeats: int = 2,
        block: int = 32, shard_words: int = 1 << 21, shard_docs: int = 1 << 12, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
        whole: bool = False) -> DataFrame:
    """Words the mix takes of every document, and the columns ``keep`` as they are.

    With ``whole`` a shard's quota goes over its documents in seeded order instead of
    over blocks: they are taken whole, and at most one of a shard in part.

    A null source is a source of its own, last in order; a null or empty text has
    size 0 and gives nothing; a null id is a document like others; repeated rows
    are documents of their own, next to each other in the seeded order of a shard; an empty
    table gives no rows; other columns are not read.  Columns: doc_id, size,
    source_size, target, taken, source.
    """
    sized = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)],
        F.xxhash64(*dict.fromkeys([id_col, source_col, text_col, *keep])).alias("_row")), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    # UTF-8 order is code point order
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.words) for r in per_source]
    target = fill_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, repeats)
    seats = sainte_lague(target, round(sum(target, Fraction(0)) / block))
    shards = [max(1, -(-size // shard_words), -(-int(r.rows) // shard_docs)) for size, r in zip(sizes, per_source)]

    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(k, r.source, sizes[k], float(target[k]), seats[k] * block, shards[k]) for k, r in enumerate(per_source)],
        "_source long, source string, source_size long, target double, parent_seats long, _shards long")
    # one row per source; copied to the tasks only below a checked number of sources
    near = F.broadcast if len(per_source) <= COPIED_SOURCES else (lambda df: df)
    dealt = _dealt(sized, shard_words, shard_docs)
    sourced = dealt.join(near(plan), dealt["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn(
        "_shard", F.pmod(F.xxhash64("_row", "_piece", F.lit(seed)), F.col("_shards")))

    shard = sourced.groupBy("_source", "_shard").agg(F.sum(F.col("size") * F.col("_copies")).alias("words")).withColumn(
        "_group", F.floor(F.col("_shard") / FAN))
    group = shard.groupBy("_source", "_group").agg(F.sum("words").alias("words")).join(
        near(plan.select("_source", "parent_seats")), "_source")
    group_seats = _divide(group, "_group").withColumnRenamed("seats", "parent_seats")
    shard_seats = _divide(shard.join(group_seats, ["_source", "_group"]), "_shard")

    def take(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rows = rows.take(np.repeat(np.arange(rows.num_rows), rows["_copies"].to_numpy()))
        size = rows["size"].to_numpy()
        ends = np.cumsum(size)
        words = int(ends[-1])
        quota = min(rows["seats"][0].as_py(), repeats * words)
        if whole:
            full, rest = divmod(quota, words) if words else (0, 0)
            return with_taken(rows, full * size + np.clip(rest - (ends - size), 0, size))
        blocks = -(-words // block)
        width = np.full(blocks, block, np.int64)
        copies = np.zeros(blocks, np.int64)
        if blocks:
            width[-1] = words - block * (blocks - 1)
            rng = np.random.Generator(np.random.PCG64([seed, rows["_source"][0].as_py(), rows["_shard"][0].as_py()]))
            order = rng.permutation(blocks)
            copies += quota // words
            filled = np.cumsum(width[order])
            chosen = int(np.searchsorted(filled, quota % words, "right"))
            copies[order[:chosen]] += 1
            part = block * int(order[chosen])  # the next block gives its first words
            missing = quota % words - (int(filled[chosen - 1]) if chosen else 0)
        before = np.concatenate([[0], np.cumsum(copies * width)])

        def taken_until(x: np.ndarray) -> np.ndarray:
            if not blocks:
                return np.zeros_like(x)
            at = np.minimum(x // block, blocks - 1)
            return before[at] + (x - at * block) * copies[at] + np.clip(x - part, 0, missing)

        return with_taken(rows, taken_until(ends) - taken_until(ends - size))

    def with_taken(rows: pa.Table, taken: np.ndarray) -> pa.Table:
        got = pa.chunked_array([pa.array(taken)])
        return pa.table([got if c == "taken" else rows[c] for c in carried], names=carried)

    # the kept columns travel under numbers: they may be named as ours
    ours = ["doc_id", "size", "source_size", "target", "taken", "source"]
    carried = [*ours, *[f"_keep{k}" for k in range(len(keep))]]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {k}" for c, k in zip(carried, ["long", "long", "long", "double", "long", "string", *[kinds[c] for c in keep]]))
    rows = sourced.join(shard_seats, ["_source", "_shard"]).withColumn("_order", F.xxhash64("_row", "_piece", F.lit(seed + 1)))
    mixed = rows.select("_source", "_shard", "_order", "_copies", "seats", *[c for c in carried if c != "taken"]).groupBy(
        "_source", "_shard").applyInArrow(take, schema)
    return mixed.select(*[c for c in ours if c not in keep], *[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)])


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word; all of it where that is null."""
    each = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.when(words.isNull(), text).otherwise(F.array_join(F.slice(each, F.lit(1), words.cast("int")), ""))
