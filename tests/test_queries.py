"""A sample of the registered queries against their SQL twins; all with TIDEBAR_ALL=1."""

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bars_from_ticks", "macd", "price_volume_relations", "market_join_as_of", "gaps_filled", "due_predictions",
    "accuracy_metrics", "backtest_records", "streamed_hourly_bars", "latest_scoring_rows",
)
NAMES = sorted(oracle_sql()) if os.environ.get("TIDEBAR_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert check.compare(spark, duck, name, SF).startswith("ok")


def test_every_twin_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 5
