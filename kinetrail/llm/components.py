"""Connected components of a link table, by alternating large and small stars.

Each round is two joins and two distincts over the links; the links of a hub are
joined, never gathered, and every round is written in the shared folder, so a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.stage import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (id, component): the least id each linked id reaches.

    Ids without links do not occur in the result; loops and repeats are harmless.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        # two 32-bit halves of a row hash: their sums do not overflow
        h = F.xxhash64("a", "b")
        seen = now.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        mark = seen
        now = written(_small_star(_large_star(now)), "links")
