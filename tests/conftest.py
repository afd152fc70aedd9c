import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from riskpanel.session import local_session  # noqa: E402
from riskpanel.sources.market import Market  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def market(spark):
    return Market(spark, SMALL)


@pytest.fixture(scope="session")
def returns(market):
    """Five brands, about a third of the calendar: enough for brute-force loops."""
    r = market.returns()
    return r.filter("entity in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') and idx <= 120").cache()


@pytest.fixture(scope="session")
def matrix(returns):
    """The same returns as a pandas frame, dates by entities."""
    return returns.select("entity", "idx", "r").toPandas().pivot(index="idx", columns="entity", values="r").sort_index()
