"""Market and two-series features, and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar import settings
from tidebar.catalog.base import (
    BY_ASSET, EVENT_BARS, change, clip_sql, corr, emit, emit_sql, event_bars, event_series, flag_sql,
    full, lag, last_known, lead, mean, opposite_sql, query, rank_sql, spec, std, table, total,
)
from tidebar.catalog.feature_queries import _FLOW, _MACD_CTES, _RSI_CTES
from tidebar.functions.scalars import clip
from tidebar.operators import cleaning
from tidebar.operators.market import add_market_features, join_market, pivot_last
from tidebar.operators.pairs import join_other
from tidebar.operators.rank import add_rolling_rank
from tidebar.operators.series import chunked
from tidebar.plans import features as fx
from tidebar.session import staged

SYMBOLS = settings.MARKET_SYMBOLS
NAMES = list(SYMBOLS.values())


def market_prints(spark, sf):
    """Prints of eight symbols, taken from the events by user."""
    symbol = F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("user_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"),
        symbol.alias("symbol"),
        F.col("value").alias("Close"),
        "ts",
    )


_CASES = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SYMBOLS))
_LAST = ", ".join(
    f"arg_max(value, ts) filter (where user_id % 8 = {i}) as {n}" for i, n in enumerate(NAMES)
)
_PIVOT = f"pivoted as (select date_trunc('hour', ts) as datetime, {_LAST} from events group by 1)"
_CARRY = ", ".join(
    f"last_value({n} ignore nulls) over (order by datetime rows between unbounded preceding and current row) as {n}"
    for n in NAMES
)
_JOINED = f"""{_PIVOT}, prints as (select datetime, {_CARRY} from pivoted), {EVENT_BARS},
j as (select bars.*, {", ".join(f"prints.{n}" for n in NAMES)} from bars left join prints using (datetime)),
m as (select * replace ({", ".join(f"{last_known(n)} as {n}" for n in NAMES)}) from j)"""

_PIVOT_OUT = spec("datetime " + " ".join(NAMES))


@query("market_pivot", f"with {_PIVOT} {emit_sql(_PIVOT_OUT, 'pivoted')}")
def market_pivot(spark, sf):
    return emit(pivot_last(market_prints(spark, sf), SYMBOLS, "ts"), _PIVOT_OUT)


_MJ_OUT = spec("asset datetime price " + " ".join(NAMES))


@query("market_join_carried", f"with {_JOINED} {emit_sql(_MJ_OUT, 'm')}")
def market_join_carried(spark, sf):
    bars = event_bars(spark, sf)
    return emit(join_market(bars, market_prints(spark, sf), "ts").rows(*_MJ_OUT), _MJ_OUT)


_ASOF = f"""with {EVENT_BARS}, prints as (select ts, user_id % 8 as s, value from events),
{", ".join(f"p{i} as (select ts + interval 30 minute as at, value from prints where s = {i})" for i in range(8))}
select bars.asset, bars.datetime, bars.price, {", ".join(f"p{i}.value as {n}" for i, n in enumerate(NAMES))}
from bars {" ".join(f"asof left join p{i} on bars.datetime >= p{i}.at" for i in range(8))}"""


@query("market_join_as_of", _ASOF)
def market_join_as_of(spark, sf):
    """Prints that never fall on a full hour: the last one at or before each bar."""
    prints = market_prints(spark, sf).withColumn("datetime", F.col("ts") + F.expr("INTERVAL '30' MINUTE"))
    return emit(join_market(event_bars(spark, sf), prints, "ts", how="asof").rows(*_MJ_OUT), _MJ_OUT)


_MF_OUT = spec("asset datetime " + " ".join(f"corr_{n}:6 ratio_{n}:6" for n in NAMES))
_MF_SQL = ", ".join(
    f"{corr('price', n, 24)} as corr_{n}, price / nullif({n}, 0) as ratio_{n}" for n in NAMES
)


@query("market_correlations", f"with {_JOINED}, f as (select *, {_MF_SQL} from m) {emit_sql(_MF_OUT, 'f')}")
def market_correlations(spark, sf):
    series = join_market(event_bars(spark, sf), market_prints(spark, sf), "ts")
    return emit(add_market_features(series).rows(*_MF_OUT), _MF_OUT)


# -- two series ----------------------------------------------------------------------------------

PAIRS = [("click", "view"), ("view", "click"), ("purchase", "signup")]


def pair_table(spark):
    return spark.createDataFrame(PAIRS, "asset string, other_asset string")


def pair_base(spark, sf):
    """The columns of one series that two-series features need."""
    s = add_rolling_rank(event_series(spark, sf), {"volume_percentile_7d": ("volume", 168)})
    for step in (
        fx.add_rsi, fx.add_macd, fx.add_bollinger, fx.add_price_changes, fx.add_obv,
        fx.add_long_volume_sums, fx.add_vwap,
    ):
        s = step(s)
    s = s.with_columns({"volatility_24h": s.std("price_change_1h", 24) * 100})
    used = {"price_change_1h", *fx.OTHER_COLUMNS.values()}
    return staged(s.rows("asset", "datetime", *sorted(used)), "pair-base")


def pair_series(spark, sf, lead_rows=0):
    return join_other(pair_base(spark, sf), pair_table(spark), fx.OTHER_COLUMNS, lead_rows)


_MID, _DEV = mean("price", 20), full("stddev_pop(price)", "price", 20)
_OTHERS = ", ".join(f"o.{src} as other_{n}" for n, src in fx.OTHER_COLUMNS.items())
_PAIR_BASE = f"""{EVENT_BARS}{_RSI_CTES}{_MACD_CTES}{_FLOW},
obv0 as (select *, {change('price')} as ret, {_MID} as mid, {_DEV} as dev from obvs),
base as (select obv0.*, rsi, macd, (price - (mid - 2 * dev)) / nullif(4 * dev, 0) as bb_position,
  ({std('ret', 24)}) * 100 as volatility_24h, ret as price_change_1h,
  ({total('price * volume', 24)}) / nullif({total('volume', 24)}, 0) as vwap_24h,
  {rank_sql('volume', 168)} as volume_percentile_7d, {total('money_flow_raw', 24)} as money_flow_24h
  from obv0 join rsi_t using (asset, rn) join macd_t using (asset, rn)),
pairs(asset, other_asset) as (values {", ".join(str(p) for p in PAIRS)}),
pj as (select b.*, pairs.other_asset, {_OTHERS} from base b join pairs using (asset)
  left join base o on o.asset = pairs.other_asset and o.datetime = b.datetime),
x0 as (select * replace ({", ".join(f"{last_known(f'other_{n}')} as other_{n}" for n in fx.OTHER_COLUMNS)}) from pj),
x as (select *, {change('other_price')} as o_ret from x0)"""


def pair_query(name, columns, sql_columns, build, ctes="", source="x", **kw):
    out = spec("asset other_asset datetime " + columns)
    select = ", ".join(f"{e} as {n}" for n, e in sql_columns.items())
    sql = f"with {_PAIR_BASE}{ctes}, f as (select *, {select} from {source}) {emit_sql(out, 'f')}"
    query(name, sql)(lambda spark, sf: emit(build(pair_series(spark, sf, **kw)).rows(*out), out))


pair_query(
    "other_series_columns",
    "other_price:6 other_volume:6 other_rsi:6 other_macd:6 other_bb_position:6 other_volatility:4 "
    "other_obv:4 other_vwap:6 other_volume_percentile:6 other_money_flow:4",
    {"one": "1"},
    lambda s: s,
)

_K = (6, 12, 24, 48, 168)
pair_query(
    "other_series_correlations",
    " ".join(f"corr_other_{k}h:6 return_corr_other_{k}h:6" for k in _K)
    + " corr_strength_other:6 corr_change_other:6 correlation_breakdown_other "
    + "high_correlation_regime_other low_correlation_regime_other",
    {f"corr_other_{k}h": corr("price", "other_price", k) for k in _K}
    | {f"return_corr_other_{k}h": corr("price_change_1h", "o_ret", k) for k in _K}
    | {
        "corr_strength_other": "abs(c24)",
        "corr_change_other": f"c24 - {lag('c24')}",
        "correlation_breakdown_other": flag_sql(f"{lag('c24', 24)} > 0.5 and c24 < 0.2"),
        "high_correlation_regime_other": flag_sql("abs(c24) > 0.7"),
        "low_correlation_regime_other": flag_sql("abs(c24) < 0.3"),
    },
    fx.add_cross_correlations,
    ctes=f", e as (select *, {corr('price', 'other_price', 24)} as c24 from x)",
    source="e",
)

_LEADS = {f"other_price_lead_{n}h": lag("other_price", n) for n in settings.LAGS} | {
    f"other_return_lead_{n}h": lag("o_ret", n) for n in settings.LAGS
}
_FUTURE = {f"to_other_lag_{n}h": lead("price", n) for n in settings.LAGS}


def _o_ret(s):
    return s.with_columns({"_o_ret": s.change("other_price")})


pair_query(
    "other_series_leads",
    " ".join(f"{n}:6" for n in _LEADS),
    _LEADS,
    lambda s: fx.add_cross_leads(_o_ret(s)),
)
pair_query(
    "other_series_leads_with_future",
    " ".join(f"{n}:6" for n in _FUTURE),
    _FUTURE,
    lambda s: fx.add_cross_leads(_o_ret(s), with_future=True),
    lead_rows=24,
)

_RATIO = clip_sql("price / (other_price + 1e-3)", "1e-6", "1e6")
pair_query(
    "other_series_ratios",
    "rsi_divergence_other:6 rsi_ratio_other:6 price_other_ratio:6 ratio_volatility_other:4 "
    "ratio_momentum_24h_other:4 " + " ".join(f"ratio_sma_{k}_other:5 ratio_vs_sma_{k}_other:5" for k in (7, 14, 30, 50)),
    {
        "rsi_divergence_other": "rsi - other_rsi",
        "rsi_ratio_other": clip_sql("rsi / nullif(other_rsi + 1e-3, 0)", "-1000", "1000"),
        "price_other_ratio": "ratio",
        "ratio_volatility_other": std("ratio", 24),
        "ratio_momentum_24h_other": change("ratio", 24),
    }
    | {f"ratio_sma_{k}_other": mean("ratio", k) for k in (7, 14, 30, 50)}
    | {
        f"ratio_vs_sma_{k}_other": clip_sql(f"ratio / (({mean('ratio', k)}) + 1e-6)", "0.01", "100")
        for k in (7, 14, 30, 50)
    },
    fx.add_cross_ratios,
    ctes=f", e as (select *, {_RATIO} as ratio from x)",
    source="e",
)

pair_query(
    "other_series_divergence",
    "price_divergence_other return_spread_other:5 volatility_spread_other:4 volatility_ratio_other:5 "
    "relative_strength_other:5 relative_strength_7d_other:5",
    {
        "price_divergence_other": opposite_sql("price_change_1h", "o_ret"),
        "return_spread_other": "price_change_1h - o_ret",
        "volatility_spread_other": "volatility_24h - other_volatility",
        "volatility_ratio_other": clip_sql("volatility_24h / (other_volatility + 1e-6)", "1e-3", "1e3"),
        "relative_strength_other": "rs",
        "relative_strength_7d_other": mean("rs", 168),
    },
    lambda s: fx.add_cross_divergence(_o_ret(s)),
    ctes=f", e as (select *, {change('price', 24)} - {change('other_price', 24)} as rs from x)",
    source="e",
)

_VR = clip_sql("volume / (other_volume + 1e-3)", "1e-6", "1e6")
pair_query(
    "other_series_volume",
    "volume_ratio_other:6 combined_volume_momentum_other:6 volume_ratio_sma_14_other:5 "
    "volume_correlation_other_24h:6 volume_momentum_divergence_other:6 combined_high_volume_other "
    "volume_divergence_other obv_correlation_other_24h:6 obv_divergence_other vwap_ratio_other:6 "
    "both_above_vwap_other money_flow_correlation_other:6 money_flow_divergence_other",
    {
        "volume_ratio_other": "vr",
        "combined_volume_momentum_other": f"({mean('volume', 4)}) / ({mean('volume', 24)}) * "
        f"(({mean('other_volume', 4)}) / ({mean('other_volume', 24)}))",
        "volume_ratio_sma_14_other": mean("vr", 14),
        "volume_correlation_other_24h": corr("volume", "other_volume", 24),
        "volume_momentum_divergence_other": f"({mean('volume', 24)}) / ({mean('volume', 168)}) - "
        f"({mean('other_volume', 24)}) / ({mean('other_volume', 168)})",
        "combined_high_volume_other": flag_sql("rv > 0.8 and ro > 0.8"),
        "volume_divergence_other": opposite_sql(change("volume"), change("other_volume")),
        "obv_correlation_other_24h": corr("obv", "other_obv", 24),
        "obv_divergence_other": opposite_sql(f"obv - {lag('obv')}", f"other_obv - {lag('other_obv')}"),
        "vwap_ratio_other": "vwap_24h / nullif(other_vwap, 0)",
        "both_above_vwap_other": flag_sql("price > vwap_24h and other_price > other_vwap"),
        "money_flow_correlation_other": corr("money_flow_24h", "other_money_flow", 24),
        "money_flow_divergence_other": opposite_sql("money_flow_24h", "other_money_flow"),
    },
    lambda s: fx.add_cross_volume(
        add_rolling_rank(s, {"_rank_volume": ("volume", 168), "_rank_other": ("other_volume", 168)})
    ),
    ctes=f""", e as (select *, {_VR} as vr, {rank_sql('volume', 168)} as rv,
  {rank_sql('other_volume', 168)} as ro from x)""",
    source="e",
)

# -- cleaning --------------------------------------------------------------------------------------

_CLEAN = ["price", "volume", "sma_7", "price_sma_7_ratio", "momentum_24h"]


def clean_base(spark, sf):
    s = fx.add_moving_averages(event_series(spark, sf, lead_rows=168))
    s = s.with_columns({"momentum_24h": s.change("_price_pad", 24) * 100})
    s = fx.add_targets(s)
    return staged(
        s.rows("asset", "datetime", "_rn", *_CLEAN, "target_1w", "target_return_1w"), "clean-base"
    )


_CLEAN_CTE = f"""{EVENT_BARS}, base as (select *, {mean('price', 7)} as sma_7,
  price / nullif({mean('price', 7)}, 0) as price_sma_7_ratio, {change('price', 24)} * 100 as momentum_24h,
  {lead('price', 168)} as target_1w, ({lead('price', 168)} / nullif(price, 0) - 1) * 100 as target_return_1w
  from bars)"""
_SIGMA = ", ".join(
    f"case when not coalesce(stddev_samp({n}) over p > 0 and abs({n} - avg({n}) over p) > 3 * stddev_samp({n}) over p, false) then {n} end as {n}"
    for n in _CLEAN
)
_SIGMA_CTE = f"{_CLEAN_CTE}, s3 as (select * replace ({_SIGMA}) from base window p as (partition by asset))"
_CLEAN_OUT = spec("asset datetime price:6 volume:6 sma_7:6 price_sma_7_ratio:6 momentum_24h:5")


@query("outliers_beyond_three_sigma", f"with {_SIGMA_CTE} {emit_sql(_CLEAN_OUT, 's3')}")
def outliers(spark, sf):
    return emit(cleaning.three_sigma(clean_base(spark, sf), _CLEAN), _CLEAN_OUT)


_FILL = ", ".join(
    f"coalesce({last_known(n)}, first_value({n} ignore nulls) over (partition by asset order by rn "
    f"rows between current row and unbounded following), 0) as {n}"
    for n in _CLEAN
)


@query("gaps_filled", f"with {_SIGMA_CTE}, g as (select * replace ({_FILL}) from s3) {emit_sql(_CLEAN_OUT, 'g')}")
def gaps_filled(spark, sf):
    rows = staged(cleaning.three_sigma(clean_base(spark, sf), _CLEAN), "sigma")
    return emit(cleaning.fill_gaps(chunked(rows, numbered=True), _CLEAN).rows(*_CLEAN_OUT), _CLEAN_OUT)


_CAP_OUT = spec("asset datetime market_cap:2 market_cap_volume_ratio:4")
_CAP_BASE = f"{EVENT_BARS}, c as (select *, market_cap / (volume + 1e-6) as market_cap_volume_ratio from bars)"


@query(
    "values_capped",
    f"""with {_CAP_BASE}, d as (select * replace (
  case when abs(market_cap) <= 1e8 then market_cap end as market_cap,
  case when abs(market_cap_volume_ratio) <= 1000 then market_cap_volume_ratio end as market_cap_volume_ratio)
  from c) {emit_sql(_CAP_OUT, 'd')}""",
)
def values_capped(spark, sf):
    bars = event_bars(spark, sf).withColumn(
        "market_cap_volume_ratio", F.col("market_cap") / (F.col("volume") + 1e-6)
    )
    capped = cleaning.cap_values(bars, ["market_cap", "market_cap_volume_ratio"], limit=1e8)
    return emit(capped, _CAP_OUT)


@query(
    "nonfinite_to_null",
    f"""with {EVENT_BARS} select asset, datetime,
  case when price > 20 then null else round(price, 6) end as price from bars""",
)
def nonfinite_to_null(spark, sf):
    """Infinities and not-a-numbers of an outside table become NULL."""
    spoiled = event_bars(spark, sf).withColumn(
        "price",
        F.when(F.col("price") > 40, F.lit(float("inf")))
        .when(F.col("price") > 20, F.lit(float("nan")))
        .otherwise(F.round("price", 6)),
    )
    return cleaning.nullify_nonfinite(spoiled, ["price"]).select("asset", "datetime", "price")


@query(
    "missing_cell_audit",
    f"""with {_SIGMA_CTE} select asset, cast(0 as bigint) as infinite_cells,
  cast(sum({" + ".join(f"({n} is null)::integer" for n in _CLEAN)}) as bigint) as missing_cells
from s3 group by asset""",
)
def missing_cell_audit(spark, sf):
    return cleaning.audit(cleaning.three_sigma(clean_base(spark, sf), _CLEAN), _CLEAN)


_TR_OUT = spec("asset datetime price:6 momentum_24h:5 target_return_1w:5")


@query(
    "rows_with_known_target",
    f"with {_CLEAN_CTE}, k as (select * from base where target_return_1w is not null) {emit_sql(_TR_OUT, 'k')}",
)
def rows_with_known_target(spark, sf):
    return emit(clean_base(spark, sf).dropna(subset=["target_return_1w"]), _TR_OUT)


_TRAIN = ", ".join(f"coalesce({n}, 0) as {n}" for n in _CLEAN)


@query(
    "training_rows",
    f"""with {_CLEAN_CTE}, k as (select * replace ({_TRAIN}) from base where target_return_1w is not null),
u as (select * from k where {" and ".join(f"abs({n}) <= 1e15" for n in _CLEAN)}) {emit_sql(_TR_OUT, 'u')}""",
)
def training(spark, sf):
    rows = cleaning.training_rows(clean_base(spark, sf), _CLEAN, ["target_return_1w"])
    return emit(rows, _TR_OUT)


@query(
    "values_clipped",
    f"""with {_CLEAN_CTE} select asset, datetime, round({clip_sql('momentum_24h', '-50', '50')}, 5) + 0.0
  as momentum_24h from base""",
)
def values_clipped(spark, sf):
    base = clean_base(spark, sf).withColumn("momentum_24h", clip("momentum_24h", -50, 50))
    return emit(base, spec("asset datetime momentum_24h:5"))
