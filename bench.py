"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from kinetrail.catalog import load
from kinetrail.catalog.base import CATALOG, samples, track

# one or two per operator family
HEADLINE = [
    "w2_double_integral", "p4_world_acceleration", "v3_clipped_samples", "w3_rolling_variance", "w5_stillest_window",
    "w9_sign_lobes", "w12_refractory_events", "w13_rest_instants", "w17_zero_phase_band", "j1_interval_join",
    "j2_asof_interpolate", "j8_near_event_mask", "j12_lag_correlation", "a1_key_statistics", "g2_impact_cycles",
    "g6_longest_cadence", "c3_detrend_set", "c10_velocity_splice", "m2_dispersion", "m5_score_per_capture",
    "k2_triple_hypotheses", "k4_ellipse_fits", "v13_marker_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kinetrail-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    took: dict[str, float] = {}
    t0 = time.time()
    samples(spark, sf_dir).count()          # index the recordings once
    track(spark, sf_dir).count()
    took["ingest_and_index"] = round(time.time() - t0, 3)
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    for name in names:
        t0 = time.time()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
