"""Rounds over stored tables read the days that they need, whatever lies before them."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tidebar.functions.clock import moment
from tidebar.plans import cycle, matching as mt
from tidebar.session import scratch_path
from tidebar.sources.tables import DAYS, SCHEMAS, Store

DAYS_KEPT, LAST = 40, dt.datetime(2024, 2, 10, 12)
START = LAST - dt.timedelta(days=DAYS_KEPT)


def price(asset, when):
    return 100.0 + (when - START).total_seconds() / 3600 % 37 + (5 if asset == "b" else 0)


def new_store(spark, days=DAYS_KEPT):
    """Two series of bars, and predictions of all horizons every six hours, of so many days."""
    store = Store(spark, scratch_path(spark, "rounds")).ensure()
    hours = [LAST - dt.timedelta(hours=h) for h in range(days * 24)]
    bars = [(a, t, price(a, t), 1.0, 1.0) for a in "ab" for t in hours] + [("old", LAST - dt.timedelta(days=12), 7.0, 1.0, 1.0)]
    store.append("bars", spark.createDataFrame(bars, "asset string, datetime timestamp_ntz, price double, volume double, market_cap double"))
    made = [(f"{a}|{h}|{t}", a, h, price(a, t) + 1, 0.5, t + dt.timedelta(hours=n), t)
            for a in "ab" for h, n in (("1h", 1), ("1d", 24), ("1w", 168)) for t in hours[1::6]]
    store.append("predictions", spark.createDataFrame(
        made, "prediction_id string, asset string, horizon string, predicted_price double, confidence double, "
              "target_timestamp timestamp_ntz, created_at timestamp_ntz"))
    return store


def as_of(hours_ago=0):
    return moment(str(LAST - dt.timedelta(hours=hours_ago)))


def all_rounds(store):
    for hours in (25, 0):
        cycle.tracking_round(store, as_of(hours))
    evaluated = cycle.evaluation_round(store, as_of())
    report = cycle.accuracy_round(store, as_of())
    parts = (evaluated, report, store.read("timeseries", as_of(400)), store.read("actual_prices", as_of(400)))
    return [sorted(map(repr, part.collect())) for part in parts]


def spoil(store, table, before):
    """No reader gets past a file of a day before ``before``."""
    spoiled = 0
    for path in glob.glob(f"{store.path(table)}/_day=*/*.parquet"):
        if re.search(r"_day=([0-9-]+)", path)[1] < before:
            with open(path, "wb") as f:
                f.write(b"no table")
            spoiled += 1
    return spoiled


def test_rounds_do_not_read_old_days(spark):
    whole, spoiled = new_store(spark), new_store(spark)
    before = str((LAST - dt.timedelta(days=24)).date())  # 25 hours and 14 days ago, and some days
    assert spoil(spoiled, "bars", before) > 10 and spoil(spoiled, "predictions", before) > 10
    with pytest.raises(Exception):
        spoiled.read("bars").agg(F.sum("price")).collect()
    want, got = all_rounds(whole), all_rounds(spoiled)
    assert got == want and all(want)
    # the rounds' own tables grow too
    for table in ("timeseries", "evaluations"):
        old = spoiled.read(table).withColumn(DAYS[table], F.col(DAYS[table]) - F.expr("INTERVAL '60' DAY"))
        spoiled.append(table, old)
        assert spoil(spoiled, table, before) > 0
    cycle.tracking_round(spoiled, as_of())
    again = cycle.accuracy_round(spoiled, as_of())
    assert sorted(map(repr, again.collect())) == want[1]


def test_ranges_are_partition_filters(spark):
    store = new_store(spark, days=3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    folders = lambda df: re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df))
    assert "_day" in folders(store.lookback("bars", as_of(), 1))[0]
    cycle.evaluation_round(store, as_of())  # an empty table has no folders
    since = as_of() - F.expr("INTERVAL '1' DAY")
    pending = mt.pending(store.read("predictions", since, as_of()), store.read("evaluations", since))
    assert len(folders(pending)) == 2 and all("_day" in f for f in folders(pending))
    assert store.lookback("bars", as_of(), 1).count() == 2 * 25


def test_the_rounds_second_run_changes_nothing(spark):
    store = new_store(spark, days=3)
    first = all_rounds(store)
    second = all_rounds(store)
    assert second[2:] == first[2:] and second[0] == []  # nothing is due twice


def test_prices_at_any_time(spark):
    store = new_store(spark, days=20)
    bars = store.read("bars").collect()
    for hours in (0, 30, 24 * 13):
        now = LAST - dt.timedelta(hours=hours)
        want = {}
        for r in bars:
            if r.datetime <= now and (r.asset not in want or r.datetime > want[r.asset][0]):
                want[r.asset] = (r.datetime, r.price)
        got = {r.asset: (r.datetime, r.price) for r in store.prices_at(as_of(hours), days=2).collect()}
        assert got == want


def test_series_tables_are_made_anew(spark):
    store = new_store(spark, days=4)
    cycle.tracking_round(store, as_of(5))
    cycle.tracking_round(store, as_of())
    rows = lambda: [sorted(map(repr, store.read(t).collect())) for t in ("newest_prices", "tracked_series")]
    before = rows()
    store.reindex()
    assert rows() == before and len(before[0]) == 3 and len(before[1]) == 3
    store.clear_predictions(confirm=True)
    assert store.read("tracked_series").isEmpty() and store.read("newest_prices").count() == 3


def test_bars_without_a_time_or_series_stay_in_the_table(spark):
    store = Store(spark, scratch_path(spark, "odd")).ensure()
    store.append("bars", spark.createDataFrame([("a", None, 1.0, 1.0, 1.0), (None, LAST, 2.0, 1.0, 1.0)], SCHEMAS["bars"]))
    assert os.path.isdir(store.path("bars")) and store.read("bars").count() == 2
    assert store.read("newest_prices").isEmpty() and store.prices_at(as_of()).isEmpty()
    assert store.read("bars", as_of(9), as_of()).count() == 1
