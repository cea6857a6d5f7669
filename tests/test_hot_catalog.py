"""Registered queries with a tiny limit for hot groups, so that every ordered window runs on blocks."""

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from pulseloom.plans import hotgroups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
NAMES = ["win2_connection_split", "agg1_connection_rows", "agg2_packet_gaps", "win5_rolling_gaps", "win6_sequence_windows",
         "win8_even_sampling", "agg13_window_statistics", "prj7_window_scaler", "ud1_scored_windows",
         "top3_beacons_by_confidence", "win7_behaviour_series", "win11_threshold_sweep", "agg23_timing_statistics",
         "prj5_exact_medians"]


@pytest.fixture(scope="module")
def tiny_limit():
    old = hotgroups.DEFAULT.min_rows
    object.__setattr__(hotgroups.DEFAULT, "min_rows", 12)
    yield
    object.__setattr__(hotgroups.DEFAULT, "min_rows", old)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_blocks(spark, tiny_limit, name):
    _, _, verdict = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok", verdict
