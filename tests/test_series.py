"""Chunked windows against pandas, on series cut into several chunks."""

import numpy as np
import pandas as pd
import pytest

from tidebar.operators.ewm import Ewm, add_ewm
from tidebar.operators.long_frames import LongFrames, add_long_frames
from tidebar.operators.rank import add_rolling_rank
from tidebar.operators.series import chunked, number_rows
from tidebar.plans import features as fx

N = 5300


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    price = 100 + np.cumsum(rng.normal(size=N))
    volume = rng.integers(1, 60, size=N).astype(float)
    volume[[10, 400, 2100]] = 1e6
    return price + 200, volume


@pytest.fixture(scope="module")
def cut(make_bars, walk):
    """One long series in three chunks of 2048 rows, and a short one."""
    price, volume = walk
    bars = make_bars({"long": price, "short": price[:40]}, {"long": volume, "short": volume[:40]})
    return lambda **kw: fx.pad_prices(chunked(bars, chunk_rows=2048, **kw))


def column(df, name, asset="long"):
    rows = df.where(f"asset = '{asset}'").select("datetime", name).toPandas().sort_values("datetime")
    return rows[name].astype(float).to_numpy()


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def test_rows_are_numbered_over_slots(make_bars):
    bars = make_bars({"a": list(range(1, 1001)), "b": [1.0, 2.0]})
    rows = number_rows(bars, ["asset"], slot_seconds=36 * 3600).toPandas().sort_values(["asset", "datetime"])
    assert rows[rows.asset == "a"]._rn.tolist() == list(range(1000))
    assert rows[rows.asset == "b"]._rn.tolist() == [0, 1]


def test_every_row_comes_back_once(cut):
    out = cut(lead_rows=168).rows(keep_position=True)
    assert out.count() == N + 40
    assert out.select("asset", "_rn").distinct().count() == N + 40


def test_short_frames_and_lags(cut, walk):
    price = pd.Series(walk[0])
    s = cut()
    df = s.with_columns(
        {"m": s.mean("price", 50), "d": s.std("price", 24), "l": s.lag("price", 24), "c": s.change("_price_pad", 4)}
    ).rows()
    same(column(df, "m"), price.rolling(50).mean())
    same(column(df, "d"), price.rolling(24).std(), 1e-7)
    same(column(df, "l"), price.shift(24))
    same(column(df, "c"), price.pct_change(4))


def test_leads_over_chunk_ends(cut, walk):
    df = fx.add_targets(cut(lead_rows=168)).rows()
    price = pd.Series(walk[0])
    same(column(df, "target_1w"), price.shift(-168))
    same(column(df, "target_direction_1d"), (price.shift(-24) > price).astype(float))


def test_ewm_matches_pandas_over_chunks(cut, walk):
    price = pd.Series(walk[0])
    specs = {"a7": Ewm.span("price", 7), "a50": Ewm.span("price", 50), "p26": Ewm.span("price", 26, adjusted=False)}
    df = add_ewm(cut(), specs).rows()
    same(column(df, "a7"), price.ewm(span=7).mean(), 1e-12)
    same(column(df, "a50"), price.ewm(span=50).mean(), 1e-12)
    same(column(df, "p26"), price.ewm(span=26, adjust=False).mean(), 1e-12)


def test_slow_ewm_is_refused(cut):
    with pytest.raises(ValueError, match="halo"):
        add_ewm(cut(), {"x": Ewm.span("price", 2000)})


def test_rsi_and_macd(cut, walk):
    price = pd.Series(walk[0])
    df = fx.add_macd(fx.add_rsi(cut())).rows()
    step = price.diff()
    up = step.clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-step).clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    same(column(df, "rsi"), 100 - 100 / (1 + up / down), 1e-9)
    line = price.ewm(span=12, adjust=False, min_periods=12).mean() - price.ewm(span=26, adjust=False, min_periods=26).mean()
    same(column(df, "macd"), line, 1e-9)
    same(column(df, "macd_signal"), line.ewm(span=9, adjust=False, min_periods=9).mean(), 1e-9)


def test_running_sum_over_chunks(cut, walk):
    price, volume = pd.Series(walk[0]), pd.Series(walk[1])
    expected = (np.sign(price.diff()).fillna(0) * volume).cumsum()
    df = fx.add_on_balance_volume(fx.add_obv(cut())).rows()
    same(column(df, "obv"), expected, 1e-9)
    same(column(df, "obv_momentum"), expected.diff(24), 1e-6)


def test_long_frames_merge_blocks(cut, walk):
    price, volume = pd.Series(walk[0]), pd.Series(walk[1])
    spec = LongFrames(168, stds={"s": "volume"}, means={"m": "price"}, corrs={"c": ("price", "volume")})
    df = add_long_frames(cut(), spec).rows()
    exact = volume.rolling(168).apply(lambda x: np.std(x, ddof=1), raw=True)
    same(column(df, "s"), exact, 1e-10)
    same(column(df, "m"), price.rolling(168).mean(), 1e-10)
    pairs = [np.nan] * 167 + [np.corrcoef(price[i - 167 : i + 1], volume[i - 167 : i + 1])[0, 1] for i in range(167, N)]
    same(column(df, "c"), pairs, 1e-8)
    assert np.isnan(column(df, "s", "short")).all()


def test_long_sums(cut, walk):
    s = cut().long_sums({"t": ("volume", 720)})
    same(column(s.rows(), "t"), pd.Series(walk[1]).rolling(720).sum(), 1e-9)


def test_rolling_rank(cut, walk):
    df = add_rolling_rank(cut(), {"r": ("volume", 168)}).rows()
    same(column(df, "r"), pd.Series(walk[1]).rolling(168).rank(pct=True))


def test_carry_forward_over_empty_chunks(make_bars):
    values = [None] * 10 + [5.0] + [None] * 4600 + [7.0] + [None] * 100
    bars = make_bars({"a": [v if v is not None else float("nan") for v in values]})
    s = chunked(bars, chunk_rows=512, halo_rows=256)
    df = s.carry_forward({"f": "price"}).rows()
    expected = pd.Series(values, dtype="float64").ffill()
    same(column(df, "f", "a"), expected)
    back = s.carry_forward({"f": "price"}, back_fill=True).rows()
    same(column(back, "f", "a"), expected.bfill())


def test_chunks_do_not_change_results(make_bars, walk):
    price, volume = walk
    bars = make_bars({"x": price[:4200]}, {"x": volume[:4200]})
    one = fx.add_technical(fx.pad_prices(chunked(bars))).rows()
    many = fx.add_technical(fx.pad_prices(chunked(bars, chunk_rows=2048))).rows()
    for name in ("sma_50", "ema_30", "rsi", "macd_histogram", "bb_position", "volatility_24h"):
        same(column(one, name, "x"), column(many, name, "x"), 1e-8)


def test_later_rows_do_not_change_earlier_ones(make_bars, walk):
    price, volume = walk
    build = lambda n: fx.add_momentum(
        fx.add_technical(fx.pad_prices(chunked(make_bars({"x": price[:n]}, {"x": volume[:n]}))))
    ).rows()
    long, short = build(900), build(700)
    for name in ("ema_30", "rsi", "macd_signal", "momentum_24h", "trend_consistency_24h"):
        same(column(long, name, "x")[:700], column(short, name, "x"), 1e-9)


def test_one_exchange_and_one_sort_for_bounded_features(cut):
    plan = fx.add_momentum(fx.add_technical(cut(lead_rows=168))).rows()._jdf.queryExecution().executedPlan().toString()
    windows = plan.split("Generate explode")[0]
    assert windows.count("Exchange hashpartitioning") == 1
    assert windows.count("Sort [") == 1


@pytest.mark.parametrize("k", [1, 24, 32, 33, 48, 168, 245, 720])
def test_long_sums_lose_nothing_to_huge_values(make_bars, k):
    n = 1100
    plain = [float((i * 7) % 11 - 5) for i in range(n)]
    odd = [1e20 if i == 5 else -1e18 if i == 300 else None if i == 700 else v for i, v in enumerate(plain)]
    s = chunked(make_bars({"a": odd}, {"a": odd}), chunk_rows=768, halo_rows=768)
    got = {r["_rn"]: r["t"] for r in s.long_sums({"t": ("price", k)}).rows("_rn", "t").collect()}
    for i in range(n):
        frame = odd[i - k + 1 : i + 1] if i >= k - 1 else []
        if not frame or None in frame:
            assert got[i] is None
        elif 1e20 in frame or -1e18 in frame:
            assert got[i] == pytest.approx(sum(frame), rel=1e-12)
        else:
            assert got[i] == sum(frame)
