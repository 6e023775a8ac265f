"""Small hand-made cases: constants, zeros, gaps, ties, short series."""

import math

import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalars
from tidebar.operators.ewm import Ewm, add_ewm
from tidebar.operators.rank import add_rolling_rank
from tidebar.operators.series import chunked
from tidebar.plans import features as fx
from tidebar.streaming import jobs


def values(df, name):
    return [r[name] for r in df.orderBy("asset", "datetime").collect()]


def test_constant_series(make_bars):
    s = fx.pad_prices(chunked(make_bars({"a": [1.0] * 30}, {"a": [2.0] * 30})))
    s = s.with_columns({"sd": s.std("price", 7), "co": s.corr("price", "volume", 7)})
    last = fx.add_bollinger(fx.add_rsi(s)).rows().orderBy("datetime").collect()[-1]
    assert last["sd"] == 0 and last["co"] is None
    assert last["bb_position"] is None and last["rsi"] == 100


def test_zero_price_and_volume_raise_nothing(make_bars):
    s = fx.pad_prices(chunked(make_bars({"a": [0.0, 1.0, 0.0, 2.0]}, {"a": [0.0] * 4})))
    s = fx.add_price_changes(fx.add_signed_volume(s)).long_sums({"v": ("volume", 2), "p": ("price", 2)})
    rows = s.with_columns({"vwap": scalars.div("p", "v")}).rows()
    assert values(rows, "vwap") == [None] * 4
    assert values(rows, "price_change_1h") == [None, None, -1.0, None]


def test_padded_and_plain_changes(make_bars):
    s = fx.pad_prices(chunked(make_bars({"a": [1.0, math.nan, 2.0]})))
    rows = s.with_columns({"padded": s.change("_price_pad"), "plain": s.change("price")}).rows()
    assert values(rows, "padded") == [None, 0.0, 1.0]
    assert values(rows, "plain") == [None, None, None]


def test_ewm_decays_over_a_gap(make_bars):
    s = chunked(make_bars({"a": [1.0, math.nan, 3.0]}))
    assert values(add_ewm(s, {"e": Ewm.span("price", 3)}).rows(), "e") == pytest.approx([1, 1, 2.6])


def test_rank_with_ties(make_bars):
    s = chunked(make_bars({"a": [1.0] * 4}, {"a": [5.0, 5.0, 7.0, 6.0]}))
    got = values(add_rolling_rank(s, {"r": ("volume", 3)}).rows(), "r")
    assert got[:2] == [None, None] and got[2:] == pytest.approx([1, 2 / 3])


def test_short_series_fall_back_to_zero(make_bars):
    s = fx.pad_prices(chunked(make_bars({"a": [1.0, 2.0, 3.0]})))
    last = fx.add_volatility(fx.add_momentum(s)).rows().orderBy("datetime").collect()[-1]
    assert last["ma_momentum_12h"] == last["hist_vol_168h"] == last["price_range_6h"] == 0
    assert last["volatility_6h"] is None and last["vol_breakout"] == 0


def test_targets_at_the_tail(make_bars):
    rows = fx.add_targets(chunked(make_bars({"a": [1.0, 2.0]}), lead_rows=168)).rows()
    assert values(rows, "target_1h") == [2.0, None]
    assert values(rows, "target_direction_1h") == [1, 0]


def test_quality_bands_include_their_limits(spark):
    rows = spark.createDataFrame([(2.0,), (5.0,), (10.0,), (10.1,)], "e double")
    bands = [r[0] for r in rows.select(scalars.quality_band("e")).collect()]
    assert bands == ["excellent", "good", "fair", "poor"]


def test_clip_keeps_missing_values(spark):
    rows = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in rows.select(scalars.clip("x", -1, 1)).collect()] == [None, 1.0, -1.0]


def test_plain_weighted_means_over_gaps(make_bars):
    import pandas as pd

    values = {"a": [None, None, 3.0, 5.0, None, 9.0, 4.0], "b": [100.0, None, 100.0, None, None, 100.0, 100.0]}
    df = add_ewm(chunked(make_bars(values)), {"x": Ewm.span("price", 5, adjusted=False)}).rows("asset", "datetime", "x")
    got = {a: [r.x for r in df.where(F.col("asset") == a).orderBy("datetime").collect()] for a in values}
    assert got["b"] == pytest.approx([100.0] * 7)
    want = pd.Series(values["a"]).ewm(span=5, adjust=False).mean().tolist()
    assert got["a"][:2] == [None, None] and got["a"][2:6] == pytest.approx(want[2:6])


def test_macd_of_a_constant_price_with_gaps_is_zero(make_bars):
    prices = [None] * 3 + [7.0 if i % 7 else None for i in range(80)]
    rows = fx.add_macd(chunked(make_bars({"a": prices}))).rows("datetime", "macd", "macd_signal").orderBy("datetime").collect()
    known = [r.macd for r in rows if r.macd is not None]
    assert known and max(map(abs, known)) < 1e-9 and rows[20].macd is None


def test_reach_beyond_a_chunk_is_refused(make_bars):
    s = chunked(make_bars({"a": [1.0] * 5}), halo_rows=256)
    for wrong in (lambda: s.mean("price", 400), lambda: s.lag("price", 257), lambda: s.lead("price", 1), lambda: s.long_sums({"x": ("price", 300)})):
        with pytest.raises(ValueError):
            wrong()


def test_infinite_input_does_not_spread(make_bars):
    from tidebar.plans import flow

    volumes = [float(i % 7 + 1) for i in range(60)]
    volumes[5] = float("inf")
    bars = make_bars({"a": [10.0 + i % 3 for i in range(60)]}, {"a": volumes})
    row = flow.raw_features(bars).orderBy(F.desc("datetime")).first()
    assert all(v is None or v == v and abs(v) < 1e18 for v in row if isinstance(v, float))
    assert row["obv"] is not None


def test_micro_batches_with_memory_equal_the_whole(spark, make_bars, tmp_path):
    prices = [10.0 + (i * 7 % 11) for i in range(120)]
    bars = make_bars({"a": prices, "b": prices[::-1]}).where((F.hour("datetime") % 5) != 3)  # with gaps
    add = lambda s: fx.add_moving_averages(s)
    whole = fx.add_moving_averages(fx.series_with_memory(bars)).rows("asset", "datetime", "obv", "high_volume_price_level", "sma_50")
    job = jobs.features_job(str(tmp_path / "bars"), str(tmp_path / "out"), add, memory=True)
    for k in range(5):
        job(bars.where(F.dayofmonth("datetime") == k + 1), k)
    got = spark.read.parquet(str(tmp_path / "out")).select(*whole.columns)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(got) == key(whole)
