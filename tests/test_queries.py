"""Registered queries against their SQL twins.

By default those that finish quickly; PITCHRANK_ALL=1 runs every one (as does
``python tests/compare.py``).
"""

import os

import pytest
from compare import difference, sql_tables

import __spark_entry__ as E

SF_DIR = os.environ.get("PITCHRANK_SF_DIR", "/root/testdata/sf0.01")
QUICK = ("normalize_codes", "season_of", "run_value", "count_leverage", "velocity_floors", "min_group_count",
         "min_group_count_events", "season_calendar", "month_ranges", "speed_diff", "clean_report",
         "unknown_descriptions", "profile_two_scans", "nearest_in_group", "zscore_events",
         "leaderboard_top20", "career", "spearman_by_type", "score_histogram", "tunnel_summary", "train_set",
         "boost_first_split", "stream_close", "replace_visible", "unchanged_months", "pitcher_scan", "profile_incremental",
         "profile_co_located")
NAMES = list(E.oracle_sql()) if os.environ.get("PITCHRANK_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return sql_tables(SF_DIR)


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    assert difference(E.queries()[name](spark, SF_DIR), sql, E.oracle_sql()[name]) is None


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[0] == "player_name" and 0 < df.count() <= 20
