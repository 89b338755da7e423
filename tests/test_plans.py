"""Plans of registered queries: no nested loops, no cartesian products."""

import pytest

from kinetrail.catalog import load
from kinetrail.catalog.base import CATALOG

SF = "/root/testdata/sf0.001"
load()
# one per operator family that joins; KINETRAIL_ALL=1 plans every query
JOINING = ["a5_curve_difference", "c10_velocity_splice", "g6_longest_cadence", "j1_interval_join", "j2_asof_interpolate", "j5_best_overlap",
           "j8_near_event_mask", "j10_suppress_static", "k2_triple_hypotheses", "w12_refractory_events", "m5_score_per_rep", "o5_rest_observables"]


def chosen():
    import os

    return sorted(CATALOG) if os.environ.get("KINETRAIL_ALL") else [n for n in JOINING if n in CATALOG]


@pytest.mark.parametrize("name", chosen())
def test_no_nested_loops(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CATALOG[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_refractory_rows_are_dealt_by_key_and_block(spark):
    """The pieces of a hot key reach Python by (key, block), not by key."""
    from pyspark.sql import functions as F

    from kinetrail.plans.blocks import reblock
    from kinetrail.plans.scans import refractory

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = reblock(spark.range(200_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("t")))
        got = refractory(rows, ["k"], "t", 10.0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(k#" in line]
        assert any("_blk" in line for line in dealt)
        assert got.count() == 200_000 // 11 + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
