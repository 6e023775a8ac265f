import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidebar-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from lists: {asset: prices}, volumes alike; hourly from 2024-01-01."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    known = lambda v: None if v is None or v != v else float(v)

    def make(prices, volumes=None):
        rows = []
        for asset, values in prices.items():
            volume = volumes[asset] if volumes else [i % 7 + 1 for i in range(len(values))]
            for i, (p, v) in enumerate(zip(values, volume)):
                p, v = known(p), known(v)
                rows.append((asset, start + dt.timedelta(hours=i), p, v, None if p is None else p * 1e6))
        return spark.createDataFrame(
            rows, "asset string, datetime timestamp_ntz, price double, volume double, market_cap double"
        )

    return make
