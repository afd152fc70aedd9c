"""Registered queries against the same query in SQL. RISKPANEL_FULL=1 runs all of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

SMALL = "/root/testdata/sf0.01"

SAMPLE = ("wide_panel_source", "period_aligned_balance", "result_catalogue", "rule_unsorted_dates", "log_returns", "rolling_windows",
          "forward_roll", "fill_linear", "mad_outliers", "smooth", "age_weights", "rank_topbottom", "describe_returns", "shapiro_test",
          "rolling_cov", "var_gev", "connectedness_in_out", "connectedness_clustering", "orthant_prior", "distress_dependence", "bsadf",
          "bubble_breakdown", "cross_quantilogram", "marginal_expected_shortfall", "caviar_path", "kendall_concordance",
          "contingent_claims", "joint_extreme_margins", "liquidity_hhlr", "roll_spread", "spillovers", "tail_entry_penalty",
          "distance_correlation", "overall_scores_simple")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RISKPANEL_FULL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 300


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
