"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns.  It is named by its smallest member
and its depth, so the table of (conversation, depth) -> node is a level-ancestor
table of the forest: the ancestor of a node at any depth is one equi-join away.
Sequences are told apart by running sums of hashes of turns and their places, taken
in blocks, so a conversation of very many turns never meets in one task; that all
members of a node end with the same turn is checked, and with it, by depth, that
they share all their turns.

The rollup splits the parent-edge forest at centroids.  The weight below a node,
its members' turns from there on, is a sum that grouping gives for free, so no
pass over the tree is needed to find one: the centroid of a component is the
lowest node with half the component's weight below it.  What lies below the
centroid inside the component is added to the centroid and to the nodes on its
way to the component's top; then the centroid goes, the subtrees of its children
and the part above become components of their own, and every one has at most
half the weight.  A pair of a node and its descendant is split, and so counted,
exactly once.  Components above ``limit`` are split by joins, one round for all of
them; smaller ones, at most ``limit`` nodes, are split inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches
from kinetrail.plans.blocks import index_series, lookup, prefix, reblock
from kinetrail.plans.stage import written

WORDS = ("w1", "w2", "w3", "w4")
KEYS = ("k1", "k2", "k3", "k4")
NODE = ["rep", "depth"]
TOP = ["top_rep", "top_depth"]
ID_BLOCK_BITS = 12


class Trie(NamedTuple):
    """``nodes``: (rep, depth, parent_rep, n_convs, n_children, n_leaves, saved_tokens); ``ends``: (conv_id, rep, depth)."""

    nodes: DataFrame
    ends: DataFrame


def series(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, n, n_bytes, w1..w4, _blk): the turns of every conversation in order, as digests.

    The order is by turn, null first, then by the digest of role and text.  Null
    role or text counts as empty.  Rows without ``conv_id`` belong to no
    conversation.  Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("n_bytes"),
        *[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(w) for k, w in enumerate(WORDS)],
        F.monotonically_increasing_id().alias("row"))
    return index_series(slim, ["conv_id"], ["turn", *WORDS, "row"]).drop("turn", "row")


def rebuild(turns: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """:func:`series` with heads exchanged: conversation c begins with the first h turns of c - c % every (all
    if fewer, none if absent) and goes on with its own after its first h; h is crc32 of decimal c modulo ``heads``."""
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).select(
        "conv_id", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(lent, "base", "left").withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "n", "base", "h", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = lookup(turns, ["conv_id"], convs.drop("base")).filter("i >= h").select(
        "conv_id", (F.col("got") + F.col("i") - F.col("h")).alias("i"), F.col("length").alias("n"), "n_bytes", *WORDS)
    head = turns.filter((F.col("i") < heads - 1) & (c % every == 0)).select(F.col("conv_id").alias("base"), "i", "n_bytes", *WORDS)
    copied = convs.filter("h > 0").drop("n").join(head, "base").filter("i < h").select(
        "conv_id", "i", F.col("length").alias("n"), "n_bytes", *WORDS)
    start = convs.select("conv_id", F.lit(-1).cast("long").alias("i"), F.col("length").alias("n"), F.lit(0).cast("long").alias("n_bytes"),
                         *[F.lit(0).cast("long").alias(w) for w in WORDS])
    return own.unionByName(copied).unionByName(start)


def _same(col: Column) -> Column:
    """The one value of a group, which must not differ."""
    return F.when(F.min(col) == F.max(col), F.min(col)).otherwise(
        F.raise_error(F.lit("two sequences of turns have one digest")))


def prefix_trie(rebuilt: DataFrame, limit: int = 50_000) -> Trie:
    """The trie of conversations given as (conv_id, i, n, n_bytes, w1..w4), with a row i = -1 for each.

    A conversation without turns belongs to the root alone; equal conversations end at one node; an empty
    table has no node, not even a root.
    """
    turns = written(reblock(rebuilt, F.greatest("i", F.lit(0))), "turns")
    mixed = [F.xxhash64(F.lit(k), *WORDS, "i") for k in (1, 2)]  # a turn and its place, in four words whose sums do not overflow
    words = [w for m in mixed for w in (m.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(m, 32))]
    summed = prefix(turns, ["conv_id"], {k: ("sum", w) for k, w in zip(KEYS, words)})
    steps = written(summed.select("conv_id", (F.col("i") + 1).alias("depth"), "n", "n_bytes", *WORDS, *KEYS), "steps")
    kinds = steps.groupBy("depth", *KEYS).agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum("n").alias("lengths"),
        _same(F.struct("n_bytes", *WORDS)).alias("last"))
    kinds = written(kinds.select("depth", *KEYS, "rep", "n_convs", F.col("last.n_bytes").alias("n_bytes"), (
        F.col("lengths") - F.col("n_convs") * (F.col("depth") - 1)).alias("below")), "kinds")
    paths = written(steps.join(kinds.select("depth", *KEYS, "rep"), ["depth", *KEYS]).select("conv_id", "depth", "n", "rep"), "paths")
    ends = paths.filter("depth = n").select("conv_id", *NODE)

    at = paths.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_rep"))
    nodes = kinds.drop(*KEYS).join(at, NODE, "left")
    fans = nodes.filter("depth > 0").groupBy(F.col("parent_rep").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(fans, NODE, "left").select(
        *NODE, "parent_rep", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "below",
        F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "nodes")
    sums = rollup(nodes, paths, limit)
    return Trie(nodes.drop("leaves", "saved", "below").join(sums, NODE).select(
        *NODE, "parent_rep", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), ends)


def rollup(nodes: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """(rep, depth, leaves, saved): sums over subtrees, of one tree whose root has depth 0.

    ``nodes`` has (rep, depth, parent_rep, n_convs, below, leaves, saved), ``paths`` (conv_id, depth, rep).
    """
    root = nodes.filter("depth = 0").select("rep", "below").first()
    now = nodes.select(*NODE, "parent_rep", "n_convs", "below", "leaves", "saved").withColumns(
        {"top_rep": F.lit(root[0] if root else None).cast("long"), "top_depth": F.lit(0).cast("long"),
         "whole": F.lit(root[1] if root else 0).cast("long")})
    done: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        sized = written(now, "sized")
        small.append(sized.filter(F.col("whole") <= limit).drop("whole"))
        large = sized.filter(F.col("whole") > limit)
        if large.isEmpty():
            break
        added, split = _split(large, paths)
        done.append(added)
        now = split.join(split.groupBy(*TOP).agg(F.max("below").alias("whole")), TOP)
    inside = _gather(small)
    bounded_batches(nodes.sparkSession)
    local = inside.repartition(*TOP).sortWithinPartitions(*TOP).select(
        *TOP, *NODE, "parent_rep", "n_convs", "below", "leaves", "saved").mapInArrow(
        lambda batches: _split_inside(batches, limit), "rep long, depth long, leaves long, saved long")
    if not done:
        return local
    return _gather([*done, local]).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("leaves", "saved")])


def _gather(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _split(large: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split every component at its centroid: (what is added to nodes, the nodes in their new components)."""
    centroid = large.filter(2 * F.col("below") >= F.col("whole")).groupBy(*TOP).agg(F.min(F.struct("below", *NODE)).alias("c")).select(
        *TOP, F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.below").alias("c_below"))
    both = large.drop("whole").join(centroid, TOP)
    above = F.col("depth") < F.col("c_depth")
    # one of the two is below the other if it has the other as its ancestor at that depth
    asked = both.withColumns({"_conv": F.when(above, F.col("c_rep")).otherwise(F.col("rep")), "_at": F.least("depth", "c_depth")})
    ancestor = paths.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_at"), F.col("rep").alias("_rep"))
    child = paths.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("rep").alias("child"))
    place = F.when((F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth")), "centre").when(
        above & (F.col("_rep") == F.col("rep")), "above").when((F.col("depth") > F.col("c_depth")) & (F.col("_rep") == F.col("c_rep")), "below").otherwise("beside")
    placed = written(asked.join(ancestor, ["_conv", "_at"]).withColumn("place", place).drop("_conv", "_at", "_rep"), "placed")
    total = placed.filter("place in ('centre', 'below')").groupBy(*TOP).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
    added = placed.filter("place in ('centre', 'above')").join(total, TOP).select(
        *NODE, F.col("t_leaves").alias("leaves"), F.col("t_saved").alias("saved"))
    own = [*NODE, "parent_rep", "n_convs", "below", "leaves", "saved", *TOP]
    under = placed.filter("place = 'below'").drop(*TOP).join(child, ["rep", "c_depth"]).withColumns(
        {"top_rep": F.col("child"), "top_depth": F.col("c_depth") + 1}).select(*own)
    rest = placed.filter("place in ('above', 'beside')").withColumn(
        "below", F.col("below") - F.when(F.col("place") == "above", F.col("c_below")).otherwise(F.lit(0))).select(*own)
    return added, under.unionByName(rest)


def _whole_components(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of some ``rows`` rows each that end where a component ends; sorted by component."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            a, b = t["top_rep"].to_numpy(), t["top_depth"].to_numpy()
            change = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            if len(change):
                yield {k: t[k].slice(0, change[-1]).to_numpy() for k in t.column_names}
                held = t.slice(change[-1]).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield {k: t[k].to_numpy() for k in t.column_names}


def _split_inside(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for t in _whole_components(batches, rows):
        leaves, saved = centroid_sums(t)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t["rep"], t["depth"], leaves, saved)],
                                         names=["rep", "depth", "leaves", "saved"])


def centroid_sums(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``leaves`` and ``saved`` over subtrees inside each component, by centroids of all components at once."""
    n = len(t["rep"])
    below, weight = t["below"].astype(np.int64), t["n_convs"].astype(np.int64)
    reps, code = np.unique(np.concatenate([t["rep"], np.nan_to_num(t["parent_rep"]).astype(np.int64)]), return_inverse=True)
    wide = len(reps)
    name = t["depth"] * wide + code[:n]
    is_top = (t["rep"] == t["top_rep"]) & (t["depth"] == t["top_depth"])
    order = np.argsort(name)
    parent = order[np.minimum(np.searchsorted(name, (t["depth"] - 1) * wide + code[n:], sorter=order), n - 1)]
    parent[is_top] = n

    # numbers so that a subtree is an interval: a node, then its children's subtrees one after the other
    by_parent = np.lexsort((np.arange(n), parent))
    run = np.cumsum(below[by_parent]) - below[by_parent]
    first = np.r_[True, parent[by_parent][1:] != parent[by_parent][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = np.zeros(n + 1, np.int64)
    step[by_parent] = run - run[start]
    step[:n] += np.append(weight, 0)[parent]
    place, up = step, np.append(parent, n)
    while (up != n).any():
        place = place + place[up]
        up = up[up]
    place, extent = place[:n], below.copy()

    # children of a node in the order of their intervals
    wide_place = int(place.max(initial=0)) + 1
    child_order = np.lexsort((place, parent))
    child_key = parent[child_order] * wide_place + place[child_order]
    top = np.maximum.accumulate(np.where(np.r_[True, (t["top_rep"][1:] != t["top_rep"][:-1]) | (t["top_depth"][1:] != t["top_depth"][:-1])], np.arange(n), 0))
    top_row = np.zeros(n, np.int64)
    np.maximum.at(top_row, top[is_top], np.flatnonzero(is_top))
    top = top_row[top]

    sums = {c: np.zeros(n, np.int64) for c in ("leaves", "saved")}
    left = np.arange(n)
    centre = np.zeros(n, np.int64)
    while len(left):
        heavy = left[2 * below[left] >= below[top[left]]]
        heavy = heavy[np.lexsort((below[heavy], top[heavy]))]
        lowest = heavy[np.r_[True, top[heavy][1:] != top[heavy][:-1]]]
        centre[top[lowest]] = lowest
        g = centre[top[left]]
        inner = (place[left] >= place[g]) & (place[left] < place[g] + extent[g])
        outer = (place[g] >= place[left]) & (place[g] < place[left] + extent[left])
        for c, out in sums.items():
            total = np.zeros(n, np.int64)
            np.add.at(total, g[inner], t[c][left[inner]])
            out[left[outer]] += total[g[outer]]
        on_way = outer & (left != g)
        cut = below[g]
        below[left[on_way]] -= cut[on_way]
        under = inner & (left != g)
        v = left[under]
        child = child_order[np.searchsorted(child_key, g[under] * wide_place + place[v], side="right") - 1]
        top[v] = child
        left = left[left != g]
    return sums["leaves"], sums["saved"]


def ends_digest(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): SHA-256 of the decimal ids that end at a node, ascending, joined by commas.

    Ids are joined in blocks of at most 4,096 ids, in parallel.  Only the
    blocks of one node pass one after the other, as SHA-256 demands, and none is kept.
    """
    blocks = written(ends.groupBy(*NODE, F.shiftright("conv_id", ID_BLOCK_BITS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")), "ends")
    of_node = blocks.groupBy(*NODE).agg(F.count(F.lit(1)).alias("blocks"), F.min("ids").alias("ids"))
    one = of_node.filter("blocks = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            done = []
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (rep, depth) == last:
                    h.update(b",")
                else:
                    if last is not None:
                        done.append((*last, h.hexdigest()))
                    last, h = (rep, depth), hashlib.sha256()
                h.update(ids.encode())
            yield _digests(done)
        if last is not None:
            yield _digests([(*last, h.hexdigest())])

    many = blocks.join(of_node.filter("blocks > 1").select(*NODE), NODE).select(*NODE, "block", "ids")
    return one.unionByName(many.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(
        run, "rep long, depth long, ends_sha256 string"))


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rep, depth, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())],
                                      names=["rep", "depth", "ends_sha256"])


#: The same in DuckDB: subtrees by joining every node with all of its ancestors.
SQL = """WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS i, n_bytes, digest FROM (
      SELECT conv_id, turn, strlen(coalesce(text, '')) AS n_bytes,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
  crc_table AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM range(256) x(b)),
  convs AS (
    SELECT conv_id AS c, n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
    FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc_table),
  sized AS (
    SELECT v.*, least(v.h, coalesce(b.n, 0)) AS got, least(v.h, coalesce(b.n, 0)) + greatest(v.n - v.h, 0) AS len
    FROM convs v LEFT JOIN convs b ON b.c = v.base),
  turns AS (
    SELECT c, len, o.i + 1 AS d, n_bytes, digest FROM sized JOIN own o ON o.conv_id = base AND o.i < h
    UNION ALL SELECT c, len, got + o.i - h + 1, n_bytes, digest FROM sized JOIN own o ON o.conv_id = c AND o.i >= h
    UNION ALL SELECT c, len, 0, 0, '' FROM sized),
  steps AS (SELECT c, d, len, n_bytes, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM turns),
  kinds AS (
    SELECT d, k, min(c) AS rep, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM steps GROUP BY d, k),
  paths AS (SELECT s.c, s.d, x.rep FROM steps s JOIN kinds x USING (d, k)),
  nodes AS (SELECT x.*, p.rep AS parent FROM kinds x LEFT JOIN paths p ON p.c = x.rep AND p.d = x.d - 1),
  fans AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
  full_nodes AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN fans f USING (rep, d)),
  sums AS (
    SELECT p.rep, p.d, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.n_bytes) AS saved_tokens
    FROM full_nodes y JOIN paths p ON p.c = y.rep AND p.d <= y.d GROUP BY ALL)
  SELECT rep::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs,
    n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
  FROM full_nodes JOIN sums USING (rep, d)"""
