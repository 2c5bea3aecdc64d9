"""Catalog queries against DuckDB on the smallest tables.

The whole catalog takes long; the default run takes a spread of it and
``FLOWTIDE_FULL=1`` takes everything.
"""

import os
from pathlib import Path

import pytest
from compare import connect, difference

from flowtide.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "b2_normalize_numeric", "b9_validate_flows", "d1_network_states", "d5_granularity_comparison", "d6_source_activity", "d7_day_profile",
    "e2_temporal_windows", "e4_build_multistep", "h2_prioritize_sources", "i6_binary_metrics", "i8_threshold_sweep", "f5_select_modes",
    "i9_score_summary", "i10_calibration_bins", "k10_request_rate", "k11_sensor_status", "a1_read_flow_csv", "a4_read_packet_jsonl",
]
NAMES = sorted(ORACLES) if os.environ.get("FLOWTIDE_FULL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()) is None


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
