"""Feature queries: one per family, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar import settings
from tidebar.catalog.base import (
    BY_ASSET, DAILY_BARS, EVENT_BARS, change, corr, daily_series, daily_series_with_memory, emit, emit_sql, event_bars,
    event_series, ewm_adjusted, ewm_plain, flag_sql, full, lag, last_known, lead, mean, opposite_sql,
    query, rank_sql, spec, std, total,
)
from tidebar.functions.clock import calendar_features
from tidebar.plans import features as fx

KEY = "asset datetime "


def simple(name, columns, sql_columns, build, bars=EVENT_BARS, ctes="", source="bars"):
    """Register a query whose SQL twin is one select over the bars."""
    out = spec(KEY + columns)
    select = ", ".join(f"{expr} as {n}" for n, expr in sql_columns.items())
    sql = f"with {bars}{ctes}, f as (select *, {select} from {source}) {emit_sql(out, 'f')}"
    query(name, sql)(lambda spark, sf: emit(build(spark, sf).rows(*out), out))


# -- technical --------------------------------------------------------------------------------

simple(
    "simple_moving_averages",
    " ".join(f"sma_{k}:6 price_sma_{k}_ratio:6" for k in settings.SMA_WINDOWS),
    {f"sma_{k}": mean("price", k) for k in settings.SMA_WINDOWS}
    | {f"price_sma_{k}_ratio": f"price / nullif({mean('price', k)}, 0)" for k in settings.SMA_WINDOWS},
    lambda spark, sf: fx.add_moving_averages(event_series(spark, sf)),
)

simple(
    "exponential_moving_averages",
    " ".join(f"ema_{k}:6 price_ema_{k}_ratio:6" for k in settings.EMA_SPANS),
    {f"price_ema_{k}_ratio": f"price / nullif(ema_{k}, 0)" for k in settings.EMA_SPANS},
    lambda spark, sf: fx.add_exponential_averages(event_series(spark, sf)),
    ctes="".join(f", {ewm_adjusted(f'ema_{k}', 'price', k)}" for k in settings.EMA_SPANS)
    + ", e as (select * from bars "
    + " ".join(f"join ema_{k}_t using (asset, rn)" for k in settings.EMA_SPANS)
    + ")",
    source="e",
)

_RSI_CTES = f""", steps as (select *, coalesce(price - {lag('price')}, 0) as step from bars),
moves as (select *, greatest(step, 0) as gain, greatest(-step, 0) as loss from steps),
{ewm_plain('up', 'gain', '(1.0::double / 14)', 0, 'moves')},
{ewm_plain('down', 'loss', '(1.0::double / 14)', 0, 'moves')},
rsi_t as (select asset, rn, case when rn >= 13 then
  case when down = 0 then 100 else 100 - 100 / (1 + up / down) end end as rsi
  from up_t join down_t using (asset, rn))"""

simple(
    "relative_strength_index",
    "rsi:6",
    {"one": "1"},
    lambda spark, sf: fx.add_rsi(event_series(spark, sf)),
    ctes=_RSI_CTES + ", e as (select * from bars join rsi_t using (asset, rn))",
    source="e",
)

_MACD_CTES = f""", {ewm_plain('fast', 'price', '(2.0::double / 13)', 0)},
{ewm_plain('slow', 'price', '(2.0::double / 27)', 0)},
line as (select asset, rn, case when rn >= 25 then fast - slow end as macd
  from fast_t join slow_t using (asset, rn)),
{ewm_plain('signal', 'macd', '(2.0::double / 10)', 25, 'line')},
macd_t as (select line.*, case when rn >= 33 then signal end as macd_signal
  from line left join signal_t using (asset, rn))"""

simple(
    "macd",
    "macd:6 macd_signal:6 macd_histogram:6",
    {"macd_histogram": "macd - macd_signal"},
    lambda spark, sf: fx.add_macd(event_series(spark, sf)),
    ctes=_MACD_CTES + ", e as (select * from bars join macd_t using (asset, rn))",
    source="e",
)

_MID, _DEV = mean("price", 20), full("stddev_pop(price)", "price", 20)
simple(
    "bollinger_bands",
    "bb_upper:6 bb_lower:6 bb_middle:6 bb_width:6 bb_position:6",
    {
        "bb_upper": "mid + 2 * dev",
        "bb_lower": "mid - 2 * dev",
        "bb_middle": "mid",
        "bb_width": "4 * dev / nullif(mid, 0)",
        "bb_position": "(price - (mid - 2 * dev)) / nullif((mid + 2 * dev) - (mid - 2 * dev), 0)",
    },
    lambda spark, sf: fx.add_bollinger(event_series(spark, sf)),
    ctes=f", e as (select *, {_MID} as mid, {_DEV} as dev from bars)",
    source="e",
)

simple(
    "price_changes",
    "price_change_1h:6 price_change_4h:6 price_change_24h:6",
    {f"price_change_{n}h": change("price", n) for n in (1, 4, 24)},
    lambda spark, sf: fx.add_price_changes(event_series(spark, sf)),
)

simple(
    "return_volatility",
    "volatility_4h:5 volatility_24h:5",
    {f"volatility_{k}h": std("ret", k) for k in (4, 24)},
    lambda spark, sf: fx.add_return_volatility(fx.add_price_changes(event_series(spark, sf))),
    ctes=f", e as (select *, {change('price')} as ret from bars)",
    source="e",
)

simple(
    "lagged_values",
    " ".join(f"price_lag_{n}:6 price_change_lag_{n}:6 rsi_lag_{n}:6" for n in settings.LAGS),
    {f"price_lag_{n}": lag("price", n) for n in settings.LAGS}
    | {f"price_change_lag_{n}": lag("ret", n) for n in settings.LAGS}
    | {f"rsi_lag_{n}": lag("rsi", n) for n in settings.LAGS},
    lambda spark, sf: fx.add_lags(fx.add_rsi(fx.add_price_changes(event_series(spark, sf)))),
    ctes=_RSI_CTES
    + f", e as (select bars.*, rsi, {change('price')} as ret from bars join rsi_t using (asset, rn))",
    source="e",
)


@query(
    "calendar_features",
    f"""with {EVENT_BARS}, f as (select asset, datetime, hour(datetime)::integer as hour,
  (isodow(datetime) - 1)::integer as day_of_week, day(datetime)::integer as day_of_month,
  month(datetime)::integer as month, quarter(datetime)::integer as quarter,
  sin(2 * pi() * hour(datetime) / 24) as hour_sin, cos(2 * pi() * hour(datetime) / 24) as hour_cos,
  sin(2 * pi() * (isodow(datetime) - 1) / 7) as day_sin, cos(2 * pi() * (isodow(datetime) - 1) / 7) as day_cos,
  (isodow(datetime) >= 6)::integer as is_weekend,
  (hour(datetime) between 14 and 21)::integer as us_market_hours,
  (hour(datetime) between 0 and 8)::integer as asian_market_hours,
  (hour(datetime) between 8 and 16)::integer as european_market_hours from bars)
select * replace (round(hour_sin, 8) + 0.0 as hour_sin, round(hour_cos, 8) + 0.0 as hour_cos,
  round(day_sin, 8) + 0.0 as day_sin, round(day_cos, 8) + 0.0 as day_cos) from f""",
)
def calendar(spark, sf):
    return emit(
        calendar_features(event_bars(spark, sf)),
        spec(
            "asset datetime hour day_of_week day_of_month month quarter hour_sin:8 hour_cos:8 "
            "day_sin:8 day_cos:8 is_weekend us_market_hours asian_market_hours european_market_hours"
        ),
    )


# -- volume (daily bars, long enough for 720 rows) -----------------------------------------------

_VW = settings.VOLUME_WINDOWS
simple(
    "volume_averages",
    " ".join(
        f"volume_sma_{k}:5 volume_ema_{k}:5 volume_ratio_sma_{k}:6 volume_ratio_ema_{k}:6" for k in _VW
    ),
    {f"volume_sma_{k}": mean("volume", k) for k in _VW}
    | {f"volume_ratio_sma_{k}": f"volume / ({mean('volume', k)} + 1e-6)" for k in _VW}
    | {f"volume_ratio_ema_{k}": f"volume / (volume_ema_{k} + 1e-6)" for k in _VW},
    lambda spark, sf: fx.add_volume_averages(event_series(spark, sf)),
    ctes="".join(f", {ewm_adjusted(f'volume_ema_{k}', 'volume', k)}" for k in _VW)
    + ", e as (select * from bars "
    + " ".join(f"join volume_ema_{k}_t using (asset, rn)" for k in _VW)
    + ")",
    source="e",
)

simple(
    "volume_percentile_ranks",
    "volume_percentile_30d:6 volume_percentile_7d:6 market_cap_percentile_30d:6",
    {
        "volume_percentile_30d": rank_sql("volume", 720),
        "volume_percentile_7d": rank_sql("volume", 168),
        "market_cap_percentile_30d": rank_sql("market_cap", 720),
    },
    lambda spark, sf: fx.add_volume_ranks(daily_series(spark, sf)),
    bars=DAILY_BARS,
)

_FLOW = f""", flows as (select *, volume * coalesce(sign(price - {lag('price')}), 0) as money_flow_raw from bars),
obvs as (select *, sum(money_flow_raw) over ({BY_ASSET} rows between unbounded preceding and current row) as obv
  from flows)"""

simple(
    "on_balance_volume",
    "money_flow_raw obv:4 obv_sma_14:4 obv_ema_14:4 obv_momentum:4 obv_acceleration:4 "
    "obv_price_correlation_24h:6 obv_price_divergence",
    {
        "obv_sma_14": mean("obv", 14),
        "obv_momentum": f"obv - {lag('obv', 24)}",
        "obv_price_correlation_24h": corr("obv", "price", 24),
        "obv_acceleration": f"mom - {lag('mom')}",
        "obv_price_divergence": opposite_sql(change("price", 24), "mom"),
    },
    lambda spark, sf: fx.add_on_balance_volume(fx.add_obv(daily_series(spark, sf))),
    bars=DAILY_BARS,
    ctes=_FLOW
    + f", {ewm_adjusted('obv_ema_14', 'obv', 14, 'obvs')}"
    + f", e as (select obvs.*, obv_ema_14, obv - {lag('obv', 24)} as mom "
    + "from obvs join obv_ema_14_t using (asset, rn))",
    source="e",
)


def _with_sums(spark, sf):
    s = fx.add_long_volume_frames(fx.add_signed_volume(daily_series(spark, sf)))
    return fx.add_long_volume_sums(s)


_VWAP = {k: f"({total('price * volume', k)}) / nullif({total('volume', k)}, 0)" for k in (24, 168, 720)}
simple(
    "volume_weighted_prices",
    " ".join(f"vwap_{k}h:5 price_vs_vwap_{k}h:6 above_vwap_{k}h" for k in (24, 168, 720)),
    {f"vwap_{k}h": v for k, v in _VWAP.items()}
    | {f"price_vs_vwap_{k}h": f"price / nullif({v}, 0)" for k, v in _VWAP.items()}
    | {f"above_vwap_{k}h": flag_sql(f"price > ({v})") for k, v in _VWAP.items()},
    lambda spark, sf: fx.add_vwap(_with_sums(spark, sf)),
    bars=DAILY_BARS,
)

simple(
    "volume_momentum",
    " ".join(f"volume_roc_{n}h:6" for n in (1, 4, 12, 24, 168))
    + " volume_acceleration_24h:6 volume_roc_acceleration:6 volume_momentum_7d:6 volume_trend_strength:6"
    + " volume_volatility_7d:6 volume_volatility_30d:6",
    {f"volume_roc_{n}h": change("volume", n) for n in (1, 4, 12, 24, 168)}
    | {
        "volume_acceleration_24h": f"roc24 - {lag('roc24')}",
        "volume_roc_acceleration": f"roc24 - {lag('roc24')}",
        "volume_momentum_7d": f"({mean('volume', 24)}) / nullif({mean('volume', 168)}, 0)",
        "volume_trend_strength": corr("rn", "volume", 24),
        "volume_volatility_7d": std("roc1", 168),
        "volume_volatility_30d": std("roc1", 720),
    },
    lambda spark, sf: fx.add_volume_momentum(_with_sums(spark, sf)),
    bars=DAILY_BARS,
    ctes=f", e as (select *, {change('volume', 24)} as roc24, {change('volume', 1)} as roc1 from bars)",
    source="e",
)


def _ranked_with_sums(spark, sf):
    s = fx.add_long_volume_frames(daily_series_with_memory(spark, sf))
    return fx.add_long_volume_sums(fx.add_volume_averages(s))


_SMA30 = mean("volume", 30)
simple(
    "volume_anomalies",
    "volume_spike_2x volume_spike_3x volume_drought volume_zscore_30d:6 high_volume_regime low_volume_regime",
    {
        "volume_spike_2x": flag_sql("volume > 2 * sma30"),
        "volume_spike_3x": flag_sql("volume > 3 * sma30"),
        "volume_drought": flag_sql("volume < 0.5 * sma30"),
        "volume_zscore_30d": f"(volume - ({mean('volume', 720)})) / (({std('volume', 720)}) + 1e-6)",
        "high_volume_regime": flag_sql("rank720 > 0.8"),
        "low_volume_regime": flag_sql("rank720 < 0.2"),
    },
    lambda spark, sf: fx.add_volume_anomalies(_ranked_with_sums(spark, sf)),
    bars=DAILY_BARS,
    ctes=f", e as (select *, {_SMA30} as sma30, {rank_sql('volume', 720)} as rank720 from bars)",
    source="e",
)


def _with_averages(spark, sf):
    s = fx.add_long_volume_frames(daily_series(spark, sf))
    s = fx.add_volume_averages(fx.add_price_changes(s))
    return s.with_columns({"_ret_24": s.change("_price_pad", 24)})


simple(
    "price_volume_relations",
    "price_volume_corr_24h:6 price_volume_corr_7d:6 volume_weighted_return_1h:6 "
    "volume_weighted_return_24h:6 price_impact_per_volume:6 volume_efficiency:6",
    {
        "price_volume_corr_24h": corr("price", "volume", 24),
        "price_volume_corr_7d": corr("price", "volume", 168),
        "volume_weighted_return_1h": f"{change('price')} * r14",
        "volume_weighted_return_24h": f"{change('price', 24)} * r14",
        "price_impact_per_volume": f"abs({change('price')}) / (r14 + 1e-6)",
        "volume_efficiency": f"abs({change('price', 24)}) / (r30 + 1e-6)",
    },
    lambda spark, sf: fx.add_price_volume_relations(_with_averages(spark, sf)),
    bars=DAILY_BARS,
    ctes=f""", e as (select *, volume / (({mean('volume', 14)}) + 1e-6) as r14,
  volume / (({_SMA30}) + 1e-6) as r30 from bars)""",
    source="e",
)

simple(
    "market_cap_features",
    "market_cap_sma_7:1 market_cap_sma_14:1 market_cap_sma_30:1 market_cap_ratio_sma_7:6 "
    "market_cap_ratio_sma_14:6 market_cap_ratio_sma_30:6 market_cap_roc_1h:6 market_cap_roc_24h:6 "
    "market_cap_roc_168h:6 market_cap_momentum_7d:6 market_cap_volatility_7d:6 "
    "market_cap_volume_ratio:3 mc_volume_correlation_24h:6",
    {f"market_cap_sma_{k}": mean("market_cap", k) for k in (7, 14, 30)}
    | {f"market_cap_ratio_sma_{k}": f"market_cap / nullif({mean('market_cap', k)}, 0)" for k in (7, 14, 30)}
    | {f"market_cap_roc_{n}h": change("market_cap", n) for n in (1, 24, 168)}
    | {
        "market_cap_momentum_7d": f"({mean('market_cap', 24)}) / nullif({mean('market_cap', 168)}, 0)",
        "market_cap_volatility_7d": std("mc1", 168),
        "market_cap_volume_ratio": "market_cap / (volume + 1e-6)",
        "mc_volume_correlation_24h": corr("market_cap", "volume", 24),
    },
    lambda spark, sf: fx.add_market_cap(_with_sums(spark, sf)),
    bars=DAILY_BARS,
    ctes=f", e as (select *, {change('market_cap')} as mc1 from bars)",
    source="e",
)

simple(
    "volume_totals_and_money_flow",
    "cumulative_volume_7d:4 cumulative_volume_30d:4 volume_concentration_24h:6 money_flow_raw "
    "money_flow_24h:4 money_flow_7d:4",
    {
        "cumulative_volume_7d": total("volume", 168),
        "cumulative_volume_30d": total("volume", 720),
        "volume_concentration_24h": f"({total('volume', 24)}) / nullif({total('volume', 168)}, 0)",
        "money_flow_24h": total("money_flow_raw", 24),
        "money_flow_7d": total("money_flow_raw", 168),
    },
    lambda spark, sf: fx.add_volume_momentum(_with_sums(spark, sf)),
    bars=DAILY_BARS,
    ctes=_FLOW,
    source="obvs",
)

simple(
    "volume_price_levels",
    "high_volume_price_level:6 distance_from_hv_level:6",
    {
        "high_volume_price_level": last_known("hv"),
        "distance_from_hv_level": f"(price - {last_known('hv')}) / nullif({last_known('hv')}, 0)",
    },
    lambda spark, sf: fx.add_level_distance(daily_series_with_memory(spark, sf)),
    bars=DAILY_BARS,
    ctes=f""", ranked as (select *, {rank_sql('volume', 168)} as p7 from bars),
e as (select *, case when p7 > 0.9 then price end as hv from ranked)""",
    source="e",
)

# -- momentum, volatility, targets ----------------------------------------------------------------


def _ma(k):
    return f"coalesce((price - ({mean('price', k)})) / nullif({mean('price', k)}, 0) * 100, 0)"


simple(
    "momentum_features",
    " ".join(f"momentum_{n}h:5 momentum_abs_{n}h:5" for n in (3, 6, 12, 24))
    + " roc_3h:5 roc_6h:5 roc_acceleration:5 velocity_1h:6 velocity_3h:6 velocity_6h:6 momentum_strength:5 "
    + " ".join(f"ma_momentum_{k}h:5" for k in (12, 24, 48))
    + " "
    + " ".join(f"trend_consistency_{k}h:6" for k in (6, 12, 24)),
    {f"momentum_{n}h": f"{change('price', n)} * 100" for n in (3, 6, 12, 24)}
    | {f"momentum_abs_{n}h": f"abs({change('price', n)} * 100)" for n in (3, 6, 12, 24)}
    | {f"velocity_{n}h": f"price - {lag('price', n)}" for n in (1, 3, 6)}
    | {f"ma_momentum_{k}h": _ma(k) for k in (12, 24, 48)}
    | {
        f"trend_consistency_{k}h": mean("rising", k)
        for k in (6, 12, 24)
    }
    | {
        "roc_3h": f"{change('price', 3)} * 100",
        "roc_6h": f"{change('price', 6)} * 100",
        "roc_acceleration": f"{change('price', 3)} * 100 - {change('price', 6)} * 100",
        "momentum_strength": "("
        + " + ".join(f"abs({change('price', n)} * 100)" for n in (3, 6, 12))
        + ") / 3",
    },
    lambda spark, sf: fx.add_momentum(event_series(spark, sf)),
    ctes=f""", e as (select *, case when {change('price')} > 0 then 1 when {change('price')} is not null
  then 0 end as rising from bars)""",
    source="e",
)


def _range(high, low, k):
    top, bottom = full(f"max({high})", high, k), full(f"min({low})", low, k)
    return f"coalesce((({top}) - ({bottom})) / nullif({bottom}, 0) * 100, 0)"


_VOL_SQL = {f"volatility_{k}h": f"v{k}" for k in (6, 12, 24, 48)} | {
    "vol_ratio_6_24": "v6 / nullif(v24, 0)",
    "vol_ratio_12_48": "v12 / nullif(v48, 0)",
    "vol_breakout": flag_sql(f"v6 > {lag('v24')} * 1.5"),
}
_VOL_SQL |= {
    f"hist_vol_{k}h": f"coalesce(({std('price', k)}) / nullif({mean('price', k)}, 0) * 100, 0)"
    for k in (24, 48, 168)
}
_VOL_CTES = f""", r as (select *, {change('price')} as ret, {lag('price')} as prev from bars),
e as (select *, greatest(high - low, abs(high - prev), abs(low - prev)) as tr,
  {", ".join(f"({std('ret', k)}) * 100 as v{k}" for k in (6, 12, 24, 48))} from r)"""
_VOL_COLUMNS = (
    "volatility_6h:4 volatility_12h:4 volatility_24h:4 volatility_48h:4 vol_ratio_6_24:6 vol_ratio_12_48:6 "
    "vol_breakout hist_vol_24h:5 hist_vol_48h:5 hist_vol_168h:5 "
    "price_range_6h:4 price_range_12h:4 price_range_24h:4"
)

simple(
    "volatility_features",
    _VOL_COLUMNS,
    _VOL_SQL | {f"price_range_{k}h": _range("price", "price", k) for k in (6, 12, 24)},
    lambda spark, sf: fx.add_volatility(event_series(spark, sf)),
    ctes=_VOL_CTES,
    source="e",
)

simple(
    "volatility_with_true_range",
    _VOL_COLUMNS + " atr_14h:6 atr_24h:6",
    _VOL_SQL
    | {f"price_range_{k}h": _range("high", "low", k) for k in (6, 12, 24)}
    | {f"atr_{k}h": mean("tr", k) for k in (14, 24)},
    lambda spark, sf: fx.add_volatility(event_series(spark, sf), ranges=True),
    ctes=_VOL_CTES,
    source="e",
)

_H = settings.HORIZONS


def _ret(n):
    return f"({lead('price', n)} / nullif(price, 0) - 1) * 100"


simple(
    "forward_targets",
    " ".join(
        f"target_{h}:6 target_return_{h}:5 target_direction_{h} target_datetime_{h}" for h in _H
    ),
    {f"target_{h}": lead("price", n) for h, n in _H.items()}
    | {f"target_return_{h}": _ret(n) for h, n in _H.items()}
    | {f"target_direction_{h}": flag_sql(f"{_ret(n)} > 0") for h, n in _H.items()}
    | {f"target_datetime_{h}": f"datetime + interval {n} hour" for h, n in _H.items()},
    lambda spark, sf: fx.add_targets(event_series(spark, sf, lead_rows=168)),
)


_HUGE = {k: f"case when rn > {5 + k} then {total('volume', k)} end as sum_{k}" for k in (24, 100, 168, 720)}
_HUGE_OUT = spec("asset rn " + " ".join(f"sum_{k}:3" for k in _HUGE))


@query(
    "sums_after_a_huge_value",
    f"""with {EVENT_BARS.replace("bars as (", "as_read as (", 1)},
bars as (select * replace (case when rn = 5 then 1e20::double else volume end as volume) from as_read),
sums as (select asset, rn, {", ".join(_HUGE.values())} from bars) {emit_sql(_HUGE_OUT, "sums")}""",
)
def sums_after_a_huge_value(spark, sf):
    """Row 5 of every series has a volume of 1e20; no later sum may show it."""
    s = event_series(spark, sf)
    s = s.with_columns({"volume": F.when(F.col("_rn") == 5, F.lit(1e20)).otherwise(F.col("volume"))})
    rows = s.long_sums({f"_{k}": ("volume", k) for k in _HUGE}).rows(keep_position=True)
    return emit(rows.select("asset", F.col("_rn").alias("rn"), *[F.when(F.col("_rn") > 5 + k, F.col(f"_{k}")).alias(f"sum_{k}") for k in _HUGE]), _HUGE_OUT)
