"""Feature families. Each takes a chunked series and returns it with more columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar import settings
from tidebar.functions.scalars import clip, div, flag, opposite
from tidebar.operators.ewm import Ewm, add_ewm
from tidebar.operators.long_frames import LongFrames, add_long_frames
from tidebar.operators.rank import add_rolling_rank
from tidebar.operators.series import Series, chunked
from tidebar.session import staged

col = F.col


def pad_prices(s: Series) -> Series:
    """Last known price, volume and market cap, for changes that skip over gaps."""
    return s.with_columns({f"_{x}_pad": s.carried(x) for x in ("price", "volume", "market_cap")})


# -- technical indicators ---------------------------------------------------------------


def add_moving_averages(s: Series) -> Series:
    s = s.with_columns({f"sma_{k}": s.mean("price", k) for k in settings.SMA_WINDOWS})
    return s.with_columns(
        {f"price_sma_{k}_ratio": div("price", f"sma_{k}") for k in settings.SMA_WINDOWS}
    )


def add_exponential_averages(s: Series) -> Series:
    s = add_ewm(s, {f"ema_{k}": Ewm.span("price", k) for k in settings.EMA_SPANS})
    return s.with_columns(
        {f"price_ema_{k}_ratio": div("price", f"ema_{k}") for k in settings.EMA_SPANS}
    )


def add_rsi(s: Series) -> Series:
    """Wilder's index: smoothed gains against smoothed losses, 100 without losses."""
    step = F.coalesce(s.diff("price"), F.lit(0.0))
    s = s.with_columns({"_step": step})
    s = s.with_columns(
        {"_gain": F.greatest(col("_step"), F.lit(0.0)), "_loss": F.greatest(-col("_step"), F.lit(0.0))}
    )
    alpha = 1.0 / settings.RSI_WINDOW
    s = add_ewm(
        s,
        {
            "_up": Ewm("_gain", alpha, adjusted=False),
            "_down": Ewm("_loss", alpha, adjusted=False),
        },
    )
    strength = F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + div("_up", "_down"))
    rsi = F.when(col("_down") == 0, F.lit(100.0)).otherwise(strength)
    known = col("_rn") >= settings.RSI_WINDOW - 1
    return s.with_columns({"rsi": F.when(known, rsi)}).drop("_step", "_gain", "_loss", "_up", "_down")


def add_macd(s: Series) -> Series:
    fast, slow, signal = settings.MACD_FAST, settings.MACD_SLOW, settings.MACD_SIGNAL
    s = add_ewm(
        s,
        {
            "_fast": Ewm.span("price", fast, adjusted=False),
            "_slow": Ewm.span("price", slow, adjusted=False),
        },
    )
    known = s.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    s = s.with_columns({"_known": F.expr(f"count(`price`) {known}")})
    s = s.with_columns({"macd": F.when(col("_known") >= slow, col("_fast") - col("_slow"))})
    s = add_ewm(s, {"_signal": Ewm.span("macd", signal, adjusted=False)})
    s = s.with_columns({"_signals": F.expr(f"count(`macd`) {known}")})
    s = s.with_columns({"macd_signal": F.when(col("_signals") >= signal, col("_signal"))})
    s = s.with_columns({"macd_histogram": col("macd") - col("macd_signal")})
    return s.drop("_fast", "_slow", "_signal", "_known", "_signals")


def add_bollinger(s: Series) -> Series:
    k, width = settings.BOLLINGER_WINDOW, float(settings.BOLLINGER_DEVIATIONS)
    s = s.with_columns({"bb_middle": s.mean("price", k), "_dev": s.pop_std("price", k)})
    s = s.with_columns(
        {
            "bb_upper": col("bb_middle") + width * col("_dev"),
            "bb_lower": col("bb_middle") - width * col("_dev"),
        }
    )
    spread = col("bb_upper") - col("bb_lower")
    return s.with_columns(
        {
            "bb_width": div(spread, "bb_middle"),
            "bb_position": div(col("price") - col("bb_lower"), spread),
        }
    ).drop("_dev")


def add_price_changes(s: Series) -> Series:
    return s.with_columns({f"price_change_{n}h": s.change("_price_pad", n) for n in (1, 4, 24)})


def add_return_volatility(s: Series) -> Series:
    return s.with_columns({f"volatility_{k}h": s.std("price_change_1h", k) for k in (4, 24)})


def add_technical(s: Series) -> Series:
    for step in (
        add_moving_averages,
        add_exponential_averages,
        add_rsi,
        add_macd,
        add_bollinger,
        add_price_changes,
        add_return_volatility,
    ):
        s = step(s)
    return s


def add_lags(s: Series) -> Series:
    lags = {}
    for n in settings.LAGS:
        lags[f"price_lag_{n}"] = s.lag("price", n)
        lags[f"price_change_lag_{n}"] = s.lag("price_change_1h", n)
        lags[f"rsi_lag_{n}"] = s.lag("rsi", n)
    return s.with_columns(lags)


# -- volume and market cap ----------------------------------------------------------------


def add_volume_ranks(s: Series) -> Series:
    return add_rolling_rank(
        s,
        {
            "volume_percentile_30d": ("volume", 720),
            "volume_percentile_7d": ("volume", 168),
            "market_cap_percentile_30d": ("market_cap", 720),
        },
    )


def add_volume_averages(s: Series) -> Series:
    windows = settings.VOLUME_WINDOWS
    s = add_ewm(s, {f"volume_ema_{k}": Ewm.span("volume", k) for k in windows})
    s = s.with_columns({f"volume_sma_{k}": s.mean("volume", k) for k in windows})
    ratios = {}
    for k in windows:
        for kind in ("sma", "ema"):
            ratios[f"volume_ratio_{kind}_{k}"] = div("volume", col(f"volume_{kind}_{k}") + 1e-6)
    return s.with_columns(ratios)


def add_signed_volume(s: Series) -> Series:
    """Volume with the sign of the price step: the raw money flow."""
    step = s.diff("price")
    sign = F.when(step > 0, 1).when(step < 0, -1).otherwise(0)
    return s.with_columns({"money_flow_raw": col("volume") * sign})


def add_obv(s: Series) -> Series:
    """On-balance volume: the signed volume since the start of the series."""
    return add_signed_volume(s).running_sum("money_flow_raw", "obv")


def add_on_balance_volume(s: Series) -> Series:
    s = add_ewm(s, {"obv_ema_14": Ewm.span("obv", 14)})
    s = s.with_columns(
        {
            "obv_sma_14": s.mean("obv", 14),
            "obv_momentum": s.diff("obv", 24),
            "obv_price_correlation_24h": s.corr("obv", "price", 24),
            "_ret_24": s.change("_price_pad", 24),
        }
    )
    return s.with_columns(
        {
            "obv_acceleration": s.diff("obv_momentum"),
            "obv_price_divergence": opposite(col("_ret_24"), col("obv_momentum")),
        }
    )


def add_long_volume_sums(s: Series) -> Series:
    """Sums over a day, a week and 30 days that several features below divide."""
    s = s.with_columns({"_pv": col("price") * col("volume")})
    return s.long_sums(
        {
            "_v_24": ("volume", 24),
            "cumulative_volume_7d": ("volume", 168),
            "cumulative_volume_30d": ("volume", 720),
            "_pv_24": ("_pv", 24),
            "_pv_168": ("_pv", 168),
            "_pv_720": ("_pv", 720),
            "money_flow_24h": ("money_flow_raw", 24),
            "money_flow_7d": ("money_flow_raw", 168),
            "_mc_24": ("market_cap", 24),
            "_mc_168": ("market_cap", 168),
        }
    ).drop("_pv")


def add_vwap(s: Series) -> Series:
    sums = {24: "_v_24", 168: "cumulative_volume_7d", 720: "cumulative_volume_30d"}
    s = s.with_columns({f"vwap_{k}h": div(f"_pv_{k}", v) for k, v in sums.items()})
    out = {}
    for k in sums:
        out[f"price_vs_vwap_{k}h"] = div("price", f"vwap_{k}h")
        out[f"above_vwap_{k}h"] = flag(col("price") > col(f"vwap_{k}h"))
    return s.with_columns(out)


def add_long_volume_frames(s: Series) -> Series:
    """What the volume family needs over a week and over 30 days."""
    s = s.with_columns(
        {"volume_roc_1h": s.change("_volume_pad"), "market_cap_roc_1h": s.change("_market_cap_pad")}
    )
    week = LongFrames(
        168,
        stds={"volume_volatility_7d": "volume_roc_1h", "market_cap_volatility_7d": "market_cap_roc_1h"},
        corrs={"price_volume_corr_7d": ("price", "volume")},
    )
    month = LongFrames(720, stds={"volume_volatility_30d": "volume_roc_1h", "_v_std_720": "volume"})
    return add_long_frames(add_long_frames(s, week), month)


def add_volume_momentum(s: Series) -> Series:
    s = s.with_columns({f"volume_roc_{n}h": s.change("_volume_pad", n) for n in (4, 12, 24, 168)})
    s = s.with_columns({"volume_acceleration_24h": s.diff("volume_roc_24h")})
    return s.with_columns(
        {
            "volume_roc_acceleration": col("volume_acceleration_24h"),
            "volume_momentum_7d": div(col("_v_24") / 24.0, col("cumulative_volume_7d") / 168.0),
            # Correlation ignores shifts, so the position in the series stands for 0..23.
            "volume_trend_strength": s.corr("_rn", "volume", 24),
            "volume_concentration_24h": div("_v_24", "cumulative_volume_7d"),
        }
    )


def add_volume_anomalies(s: Series) -> Series:
    typical = col("volume_sma_30")
    return s.with_columns(
        {
            "volume_spike_2x": flag(col("volume") > 2 * typical),
            "volume_spike_3x": flag(col("volume") > 3 * typical),
            "volume_drought": flag(col("volume") < 0.5 * typical),
            "volume_zscore_30d": div(
                col("volume") - col("cumulative_volume_30d") / 720.0, col("_v_std_720") + 1e-6
            ),
            "high_volume_regime": flag(col("volume_percentile_30d") > 0.8),
            "low_volume_regime": flag(col("volume_percentile_30d") < 0.2),
        }
    )


def add_price_volume_relations(s: Series) -> Series:
    ret_1, ret_24 = col("price_change_1h"), col("_ret_24")
    return s.with_columns(
        {
            "price_volume_corr_24h": s.corr("price", "volume", 24),
            "volume_weighted_return_1h": ret_1 * col("volume_ratio_sma_14"),
            "volume_weighted_return_24h": ret_24 * col("volume_ratio_sma_14"),
            "price_impact_per_volume": div(F.abs(ret_1), col("volume_ratio_sma_14") + 1e-6),
            "volume_efficiency": div(F.abs(ret_24), col("volume_ratio_sma_30") + 1e-6),
        }
    )


def add_market_cap(s: Series) -> Series:
    s = s.with_columns(
        {f"market_cap_sma_{k}": s.mean("market_cap", k) for k in (7, 14, 30)}
        | {f"market_cap_roc_{n}h": s.change("_market_cap_pad", n) for n in (24, 168)}
        | {"mc_volume_correlation_24h": s.corr("market_cap", "volume", 24)}
    )
    return s.with_columns(
        {f"market_cap_ratio_sma_{k}": div("market_cap", f"market_cap_sma_{k}") for k in (7, 14, 30)}
        | {
            "market_cap_momentum_7d": div(col("_mc_24") / 24.0, col("_mc_168") / 168.0),
            "market_cap_volume_ratio": div("market_cap", col("volume") + 1e-6),
        }
    )


def add_volume_level(s: Series) -> Series:
    """The price at the last very high volume of the series."""
    s = s.with_columns({"_hv": F.when(col("volume_percentile_7d") > 0.9, col("price"))})
    return s.carry_forward({"high_volume_price_level": "_hv"}).drop("_hv")


def add_level_distance(s: Series) -> Series:
    level = col("high_volume_price_level")
    return s.with_columns({"distance_from_hv_level": div(col("price") - level, level)})


def series_with_memory(bars: DataFrame, lead_rows: int = 0, numbered: bool = False) -> Series:
    """Series with the columns that look back without limit (or need a rank): signed
    volume, on-balance volume, percentile ranks, the high-volume price level.

    They are made on the narrow bars and written once; everything added later has
    bounded frames and needs one exchange and one sort in all.
    """
    ranked = add_volume_ranks(add_obv(chunked(bars, numbered=numbered)))
    rows = staged(ranked.rows(keep_position=True), "ranked-bars")
    return pad_prices(add_volume_level(chunked(rows, lead_rows=lead_rows, numbered=True)))


def add_volume(s: Series) -> Series:
    """All volume and market-cap features, on a series with memory."""
    for step in (
        add_long_volume_frames,
        add_volume_averages,
        add_on_balance_volume,
        add_long_volume_sums,
        add_vwap,
        add_volume_momentum,
        add_volume_anomalies,
        add_price_volume_relations,
        add_market_cap,
        add_level_distance,
    ):
        s = step(s)
    return s.drop(
        "_ret_24", "_v_24", "_pv_24", "_pv_168", "_pv_720", "_mc_24", "_mc_168", "_v_std_720"
    )


# -- momentum and volatility ----------------------------------------------------------------


def add_momentum(s: Series) -> Series:
    periods = (3, 6, 12, 24)
    s = s.with_columns(
        {f"momentum_{n}h": s.change("_price_pad", n) * 100 for n in periods}
        | {f"_ma_{k}": s.mean("price", k) for k in (12, 24, 48)}
        | {f"velocity_{n}h": s.diff("price", n) for n in (1, 3, 6)}
        | {"_step_return": s.change("_price_pad", 1)}
    )
    rising = F.when(col("_step_return").isNotNull(), (col("_step_return") > 0).cast("double"))
    s = s.with_columns({"_rising": rising})
    out = {f"momentum_abs_{n}h": F.abs(f"momentum_{n}h") for n in periods}
    out |= {
        "roc_3h": col("momentum_3h"),
        "roc_6h": col("momentum_6h"),
        "roc_acceleration": col("momentum_3h") - col("momentum_6h"),
        "momentum_strength": (
            F.abs("momentum_3h") + F.abs("momentum_6h") + F.abs("momentum_12h")
        )
        / 3.0,
    }
    for k in (12, 24, 48):
        away = div(col("price") - col(f"_ma_{k}"), f"_ma_{k}") * 100
        out[f"ma_momentum_{k}h"] = F.coalesce(away, F.lit(0.0))
    for k in (6, 12, 24):
        out[f"trend_consistency_{k}h"] = s.mean("_rising", k)
    return s.with_columns(out).drop("_ma_12", "_ma_24", "_ma_48", "_step_return", "_rising")


def add_volatility(s: Series, ranges: bool = False) -> Series:
    """Volatility in percent. ``ranges``: the bars have high and low, so use them and
    add the average true range; otherwise the price stands in for both."""
    windows = (6, 12, 24, 48)
    high, low = ("high", "low") if ranges else ("price", "price")
    s = s.with_columns({"_vol_return": s.change("_price_pad", 1)})
    s = add_long_frames(s, LongFrames(168, stds={"_p_std_168": "price"}, means={"_p_mean_168": "price"}))
    s = s.with_columns({f"volatility_{k}h": s.std("_vol_return", k) * 100 for k in windows})
    out = {
        "vol_ratio_6_24": div("volatility_6h", "volatility_24h"),
        "vol_ratio_12_48": div("volatility_12h", "volatility_48h"),
        "vol_breakout": flag(col("volatility_6h") > s.lag("volatility_24h") * 1.5),
    }
    for k in (24, 48):
        share = div(s.std("price", k), s.mean("price", k)) * 100
        out[f"hist_vol_{k}h"] = F.coalesce(share, F.lit(0.0))
    out["hist_vol_168h"] = F.coalesce(div("_p_std_168", "_p_mean_168") * 100, F.lit(0.0))
    for k in (6, 12, 24):
        bottom = s.lowest(low, k)
        out[f"price_range_{k}h"] = F.coalesce(
            div(s.highest(high, k) - bottom, bottom) * 100, F.lit(0.0)
        )
    if ranges:
        before = s.lag("price")
        out["_true_range"] = F.greatest(
            col("high") - col("low"), F.abs(col("high") - before), F.abs(col("low") - before)
        )
    s = s.with_columns(out).drop("_vol_return", "_p_std_168", "_p_mean_168")
    if ranges:
        s = s.with_columns({f"atr_{k}h": s.mean("_true_range", k) for k in (14, 24)})
        s = s.drop("_true_range")
    return s


# -- targets ----------------------------------------------------------------------------------


def add_targets(s: Series) -> Series:
    """Forward prices, returns, directions and target times; needs ``lead_rows``."""
    out = {f"target_{h}": s.lead("price", n) for h, n in settings.HORIZONS.items()}
    s = s.with_columns(out)
    out = {}
    for h, n in settings.HORIZONS.items():
        out[f"target_return_{h}"] = (div(f"target_{h}", "price") - 1) * 100
        out[f"target_direction_{h}"] = flag((div(f"target_{h}", "price") - 1) * 100 > 0)
        out[f"target_datetime_{h}"] = col("datetime") + F.expr(f"INTERVAL '{n}' HOUR")
    return s.with_columns(out)


# -- two series ---------------------------------------------------------------------------------

OTHER_COLUMNS = {
    "price": "price",
    "volume": "volume",
    "rsi": "rsi",
    "macd": "macd",
    "bb_position": "bb_position",
    "volatility": "volatility_24h",
    "obv": "obv",
    "vwap": "vwap_24h",
    "volume_percentile": "volume_percentile_7d",
    "money_flow": "money_flow_24h",
}


def add_cross_correlations(s: Series) -> Series:
    windows = (6, 12, 24, 48)
    s = s.with_columns({"_o_ret": s.change("other_price")})
    pairs = {
        "corr_other_168h": ("price", "other_price"),
        "return_corr_other_168h": ("price_change_1h", "_o_ret"),
    }
    s = add_long_frames(s, LongFrames(168, corrs=pairs))
    s = s.with_columns(
        {f"corr_other_{k}h": s.corr("price", "other_price", k) for k in windows}
        | {f"return_corr_other_{k}h": s.corr("price_change_1h", "_o_ret", k) for k in windows}
    )
    s = s.with_columns(
        {
            "corr_strength_other": F.abs("corr_other_24h"),
            "corr_change_other": s.diff("corr_other_24h"),
            "correlation_breakdown_other": flag(
                (s.lag("corr_other_24h", 24) > 0.5) & (col("corr_other_24h") < 0.2)
            ),
        }
    )
    return s.with_columns(
        {
            "high_correlation_regime_other": flag(col("corr_strength_other") > 0.7),
            "low_correlation_regime_other": flag(col("corr_strength_other") < 0.3),
        }
    )


def add_cross_leads(s: Series, with_future: bool = False) -> Series:
    """Past values of the other series. ``with_future`` adds the columns that look ahead
    in this series; they leak the answer and exist only to reproduce old results."""
    out = {}
    for n in settings.LAGS:
        out[f"other_price_lead_{n}h"] = s.lag("other_price", n)
        out[f"other_return_lead_{n}h"] = s.lag("_o_ret", n)
        if with_future:
            out[f"to_other_lag_{n}h"] = s.lead("price", n)
    return s.with_columns(out)


def add_cross_ratios(s: Series) -> Series:
    windows = (7, 14, 30, 50)
    s = s.with_columns(
        {
            "rsi_divergence_other": col("rsi") - col("other_rsi"),
            "rsi_ratio_other": clip(div("rsi", col("other_rsi") + 1e-3), -1000, 1000),
            "price_other_ratio": clip(div("price", col("other_price") + 1e-3), 1e-6, 1e6),
        }
    )
    ratio = col("price_other_ratio")
    s = s.with_columns(
        {f"ratio_sma_{k}_other": s.mean("price_other_ratio", k) for k in windows}
        | {
            "ratio_volatility_other": s.std("price_other_ratio", 24),
            "ratio_momentum_24h_other": s.change("price_other_ratio", 24),
        }
    )
    return s.with_columns(
        {
            f"ratio_vs_sma_{k}_other": clip(div(ratio, col(f"ratio_sma_{k}_other") + 1e-6), 0.01, 100)
            for k in windows
        }
    )


def add_cross_divergence(s: Series) -> Series:
    s = s.with_columns(
        {
            "_p_ret": s.change("price"),
            "_p_ret_24": s.change("price", 24),
            "_o_ret_24": s.change("other_price", 24),
        }
    )
    s = s.with_columns(
        {
            "price_divergence_other": opposite(col("_p_ret"), col("_o_ret")),
            "return_spread_other": col("_p_ret") - col("_o_ret"),
            "volatility_spread_other": col("volatility_24h") - col("other_volatility"),
            "volatility_ratio_other": clip(
                div("volatility_24h", col("other_volatility") + 1e-6), 1e-3, 1e3
            ),
            "relative_strength_other": col("_p_ret_24") - col("_o_ret_24"),
        }
    )
    s = s.long_sums({"_rs_168": ("relative_strength_other", 168)})
    return s.with_columns({"relative_strength_7d_other": col("_rs_168") / 168.0}).drop(
        "_p_ret", "_p_ret_24", "_o_ret_24", "_rs_168"
    )


def add_cross_volume(s: Series) -> Series:
    """Needs the rolling ranks ``_rank_volume`` and ``_rank_other`` (168 rows)."""
    s = s.long_sums(
        {
            "_v4": ("volume", 4),
            "_v24": ("volume", 24),
            "_v168": ("volume", 168),
            "_o4": ("other_volume", 4),
            "_o24": ("other_volume", 24),
            "_o168": ("other_volume", 168),
        }
    )
    s = s.with_columns(
        {
            "volume_ratio_other": clip(div("volume", col("other_volume") + 1e-3), 1e-6, 1e6),
            "_v_ret": s.change("volume"),
            "_ov_ret": s.change("other_volume"),
            "volume_correlation_other_24h": s.corr("volume", "other_volume", 24),
            "_obv_step": s.diff("obv"),
            "_o_obv_step": s.diff("other_obv"),
            "obv_correlation_other_24h": s.corr("obv", "other_obv", 24),
            "money_flow_correlation_other": s.corr("money_flow_24h", "other_money_flow", 24),
        }
    )
    short = div(col("_v4") / 4, col("_v24") / 24) * div(col("_o4") / 4, col("_o24") / 24)
    long = div(col("_v24") / 24, col("_v168") / 168) - div(col("_o24") / 24, col("_o168") / 168)
    return s.with_columns(
        {
            "combined_volume_momentum_other": short,
            "volume_ratio_sma_14_other": s.mean("volume_ratio_other", 14),
            "volume_momentum_divergence_other": long,
            "combined_high_volume_other": flag((col("_rank_volume") > 0.8) & (col("_rank_other") > 0.8)),
            "volume_divergence_other": opposite(col("_v_ret"), col("_ov_ret")),
            "obv_divergence_other": opposite(col("_obv_step"), col("_o_obv_step")),
            "vwap_ratio_other": div("vwap_24h", "other_vwap"),
            "both_above_vwap_other": flag(
                (col("price") > col("vwap_24h")) & (col("other_price") > col("other_vwap"))
            ),
            "money_flow_divergence_other": opposite(col("money_flow_24h"), col("other_money_flow")),
        }
    ).drop(
        "_v4", "_v24", "_v168", "_o4", "_o24", "_o168", "_v_ret", "_ov_ret", "_obv_step",
        "_o_obv_step", "_rank_volume", "_rank_other",
    )
