"""Registered queries against DuckDB.  KINETRAIL_ALL=1 runs every one."""

import os

import pytest
from oracle import compare, connect

from kinetrail.catalog import load
from kinetrail.catalog.base import CATALOG

load()
SF = os.environ.get("KINETRAIL_SF", "/root/testdata/sf0.001")
QUICK = ("w1_spacing w2_double_integral w2_exact_final p2_rotations p4_world_acceleration v3_clipped_samples "
         "w3_rolling_variance w5_stillest_window w6_hold_windows w8_runs w9_sign_lobes w12_refractory_events j1_interval_join "
         "j2_asof_interpolate j10_suppress_static a1_key_statistics g6_longest_cadence g9_full_cycles c2_velocity_closure_detrend "
         "m1_resample_reps k2_triple_hypotheses s8_pair_clip").split()
# these look across block borders in every way the layout allows
BORDERS = ("w1_spacing w2_double_integral w2_exact_final w3_rolling_variance w4_smooth w5_stillest_window w6_hold_windows w8_runs "
           "w9_sign_lobes w12_refractory_events w13_rest_instants w15_gradient v16_stationary_mask j1_interval_join c4_knot_detrend "
           "j12_lag_correlation g2_impact_cycles").split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CATALOG) if os.environ.get("KINETRAIL_ALL") else QUICK)
def test_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, CATALOG[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", BORDERS)
def test_matches_sql_with_tiny_blocks(small_blocks, con, name):
    ok, message, _ = compare(small_blocks, con, name, CATALOG[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", "w3_rolling_variance w5_stillest_window w6_hold_windows v16_stationary_mask".split())
def test_windows_within_a_block(small_blocks, con, name):
    """The same by frames over copied border rows; seven rows a block take the way by running totals."""
    small_blocks.conf.set("kinetrail.blockRows", "1100")
    ok, message, _ = compare(small_blocks, con, name, CATALOG[name], SF)
    assert ok, message
