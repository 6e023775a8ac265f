"""The feature columns, known before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidebar import settings
from tidebar.operators.series import Series
from tidebar.plans import features as fx

_H = settings.HORIZONS


def _each(pattern: str, values) -> list[str]:
    return [pattern.format(v) for v in values]


RAW = ["price", "volume", "market_cap"]
TECHNICAL = [
    *_each("sma_{}", settings.SMA_WINDOWS),
    *_each("price_sma_{}_ratio", settings.SMA_WINDOWS),
    *_each("ema_{}", settings.EMA_SPANS),
    *_each("price_ema_{}_ratio", settings.EMA_SPANS),
    "rsi", "macd", "macd_signal", "macd_histogram",
    "bb_upper", "bb_lower", "bb_middle", "bb_width", "bb_position",
    *_each("price_change_{}h", (1, 4, 24)),
    "volatility_4h", "volatility_24h",
]
CALENDAR = [
    "hour", "day_of_week", "day_of_month", "month", "quarter", "hour_sin", "hour_cos", "day_sin", "day_cos",
    "is_weekend", "us_market_hours", "asian_market_hours", "european_market_hours",
]
LAGS = [f"{n}_{k}" for k in settings.LAGS for n in ("price_lag", "price_change_lag", "rsi_lag")]
VOLUME = [
    *[f"volume_{kind}_{k}" for k in settings.VOLUME_WINDOWS for kind in ("sma", "ema", "ratio_sma", "ratio_ema")],
    "volume_percentile_30d", "volume_percentile_7d",
    "obv", "obv_sma_14", "obv_ema_14", "obv_momentum", "obv_acceleration",
    "obv_price_correlation_24h", "obv_price_divergence",
    *[f"{n}_{k}h" for k in (24, 168, 720) for n in ("vwap", "price_vs_vwap", "above_vwap")],
    *_each("volume_roc_{}h", (1, 4, 12, 24, 168)),
    "volume_acceleration_24h", "volume_momentum_7d", "volume_trend_strength",
    "volume_spike_2x", "volume_spike_3x", "volume_drought",
    "volume_volatility_7d", "volume_volatility_30d", "volume_zscore_30d",
    "price_volume_corr_24h", "price_volume_corr_7d",
    "volume_weighted_return_1h", "volume_weighted_return_24h", "price_impact_per_volume",
    "high_volume_regime", "low_volume_regime",
    "market_cap_sma_7", "market_cap_sma_14", "market_cap_sma_30",
    "market_cap_ratio_sma_7", "market_cap_ratio_sma_14", "market_cap_ratio_sma_30",
    "market_cap_roc_1h", "market_cap_roc_24h", "market_cap_roc_168h",
    "market_cap_momentum_7d", "market_cap_volatility_7d", "market_cap_volume_ratio",
    "mc_volume_correlation_24h", "market_cap_percentile_30d",
    "volume_roc_acceleration", "volume_efficiency", "cumulative_volume_7d", "cumulative_volume_30d",
    "volume_concentration_24h", "money_flow_raw", "money_flow_24h", "money_flow_7d",
    "high_volume_price_level", "distance_from_hv_level",
]
MOMENTUM = [
    *[f"{n}_{k}h" for k in (3, 6, 12, 24) for n in ("momentum", "momentum_abs")],
    "roc_3h", "roc_6h", "roc_acceleration",
    *_each("ma_momentum_{}h", (12, 24, 48)),
    *_each("velocity_{}h", (1, 3, 6)),
    "momentum_strength",
    *_each("trend_consistency_{}h", (6, 12, 24)),
]
VOLATILITY = [
    *_each("volatility_{}h", (6, 12, 48)),
    *_each("hist_vol_{}h", (24, 48, 168)),
    "vol_ratio_6_24", "vol_ratio_12_48",
    *_each("price_range_{}h", (6, 12, 24)),
    "vol_breakout",
]
RANGES = ["high", "low", "atr_14h", "atr_24h"]
MARKET = [f"{n}{s}" for s in settings.MARKET_SYMBOLS.values() for n in ("", "corr_", "ratio_")]
TARGETS = [
    f"{kind}_{h}" for kind in ("target", "target_return", "target_direction", "target_datetime") for h in _H
]
FUTURE = _each("to_other_lag_{}h", settings.LAGS)
CROSS = [
    *[f"other_{n}" for n in fx.OTHER_COLUMNS],
    *[f"{n}_other_{k}h" for k in (6, 12, 24, 48, 168) for n in ("corr", "return_corr")],
    "corr_strength_other", "corr_change_other",
    *[f"other_{n}_lead_{k}h" for k in settings.LAGS for n in ("price", "return")],
    "rsi_divergence_other", "rsi_ratio_other", "price_other_ratio",
    *[f"ratio_{n}_{k}_other" for k in (7, 14, 30, 50) for n in ("sma", "vs_sma")],
    "ratio_volatility_other", "ratio_momentum_24h_other",
    "price_divergence_other", "return_spread_other",
    "volume_ratio_other", "combined_volume_momentum_other",
    "volatility_spread_other", "volatility_ratio_other",
    "high_correlation_regime_other", "low_correlation_regime_other", "correlation_breakdown_other",
    "relative_strength_other", "relative_strength_7d_other",
    "volume_correlation_other_24h", "volume_ratio_sma_14_other", "volume_momentum_divergence_other",
    "combined_high_volume_other", "volume_divergence_other",
    "obv_correlation_other_24h", "obv_divergence_other",
    "vwap_ratio_other", "both_above_vwap_other",
    "money_flow_correlation_other", "money_flow_divergence_other",
]
# Words that a feature reading the future would carry in its name.
SUSPICIOUS = ("future", "next", "forward", "ahead", "target")


def single_features(market: bool = False, ranges: bool = False) -> list[str]:
    """Feature columns of one series: 174 without, 198 with the eight market symbols."""
    return [
        *RAW, *TECHNICAL, *CALENDAR, *(MARKET if market else []), *LAGS, *VOLUME, *MOMENTUM, *VOLATILITY,
        *(RANGES if ranges else []),
    ]


def all_features(market: bool = False, ranges: bool = False, with_future: bool = False) -> list[str]:
    """With the features of a second series; six of them look ahead and are off."""
    return [*single_features(market, ranges), *CROSS, *(FUTURE if with_future else [])]


@dataclass(frozen=True)
class Family:
    """An own feature family: the columns it adds and how."""

    name: str
    columns: tuple[str, ...]
    add: Callable[[Series], Series]
