"""From bars to clean feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidebar import settings
from tidebar.functions.clock import calendar_features
from tidebar.functions.scalars import ColumnOrName
from tidebar.operators import cleaning
from tidebar.operators.market import add_market_features, join_market
from tidebar.operators.pairs import join_other
from tidebar.operators.rank import add_rolling_rank
from tidebar.operators.series import chunked
from tidebar.plans import features as fx, registry
from tidebar.plans.registry import Family
from tidebar.session import staged

LEAD = max(settings.HORIZONS.values())


def raw_features(
    bars: DataFrame,
    market: DataFrame | None = None,
    market_order: ColumnOrName = "datetime",
    ranges: bool = False,
    market_join: str = "exact",
    families: Sequence[Family] = (),
) -> DataFrame:
    """All features and targets of every series, before cleaning. Written once."""
    bars = bars if ranges else bars.drop("high", "low")
    # An infinite or undefined input would go on into every sum after it.
    bars = cleaning.nullify_nonfinite(bars, [n for n in ("price", "volume", "market_cap", "high", "low") if n in bars.columns])
    if market is not None:
        bars = join_market(bars, market, market_order, how=market_join).rows(keep_position=True)
    series = fx.series_with_memory(bars, LEAD, numbered=market is not None)
    series = fx.add_technical(series)
    if market is not None:
        series = add_market_features(series)
    series = fx.add_volume(fx.add_lags(series))
    series = fx.add_volatility(fx.add_momentum(series), ranges)
    for family in families:
        series = family.add(series)
    series = fx.add_targets(series)
    extra = [n for family in families for n in family.columns]
    names = [*registry.single_features(market is not None, ranges), *extra]
    timed = calendar_features(series.rows(keep_position=True))
    return staged(timed.select("asset", "datetime", "_rn", *names, *registry.TARGETS), "features")


def prepare_features(
    bars: DataFrame,
    market: DataFrame | None = None,
    market_order: ColumnOrName = "datetime",
    ranges: bool = False,
    keep_flags: Sequence[str] = (),
    **kw,
) -> DataFrame:
    """Features of every series with outliers beyond three deviations removed."""
    raw = raw_features(bars, market, market_order, ranges, **kw)
    names = [n for n in raw.columns if n not in ("asset", "datetime", "_rn", *registry.TARGETS)]
    cleaned = cleaning.three_sigma(raw, names, keep_flags=keep_flags)
    # Whole numbers with holes are doubles from here on.
    return cleaned.withColumns({n: F.col(n).cast("double") for n in names})


def cross_features(features: DataFrame, pairs: DataFrame, with_future: bool = False) -> DataFrame:
    """The columns that compare each listed series with another one."""
    used = {"price_change_1h", "_rn", *fx.OTHER_COLUMNS.values()}
    narrow = staged(features.select("asset", "datetime", *sorted(used)), "pair-base")
    lead = max(settings.LAGS) if with_future else 0
    series = join_other(narrow.withColumnRenamed("_rn", "_row"), pairs, fx.OTHER_COLUMNS, lead)
    series = add_rolling_rank(series, {"_rank_volume": ("volume", 168), "_rank_other": ("other_volume", 168)})
    series = fx.add_cross_correlations(series)
    series = fx.add_cross_leads(series, with_future)
    series = fx.add_cross_volume(fx.add_cross_divergence(fx.add_cross_ratios(series)))
    names = [*registry.CROSS, *(registry.FUTURE if with_future else [])]
    return series.rows("asset", "other_asset", "_row", *names)


def prepare_with_pairs(
    bars: DataFrame,
    pairs: DataFrame,
    market: DataFrame | None = None,
    market_order: ColumnOrName = "datetime",
    reference_compat: bool = False,
    causal: bool = False,
    limit: float = 1e10,
    **kw,
) -> DataFrame:
    """Clean features of every listed pair: outliers out, cross features in, caps, gaps
    filled. ``reference_compat`` adds the columns that look ahead; ``causal`` fills no
    row from later ones."""
    features = staged(prepare_features(bars, market, market_order, **kw), "prepared")
    cross = cross_features(features, pairs, reference_compat)
    wide = features.withColumnRenamed("_rn", "_row").join(cross, ["asset", "_row"])
    keys = ("asset", "other_asset", "datetime", "_row")
    names = [n for n in wide.columns if n not in (*keys, *registry.TARGETS)]
    capped = staged(cleaning.cap_values(wide, names, limit).withColumnRenamed("_row", "_rn"), "capped")
    series = chunked(capped, keys=("asset", "other_asset"), numbered=True)
    return cleaning.fill_gaps(series, names, causal).rows(keep_position=True)


def prepare_with_fallback(
    bars: DataFrame,
    pairs: DataFrame,
    market: DataFrame | None = None,
    market_order: ColumnOrName = "datetime",
    reference_compat: bool = False,
    causal: bool = False,
    limit: float = 1e10,
    **kw,
) -> tuple[DataFrame, str | None]:
    """Pair features, or those of single series, with the same market and options, when the
    pairs cannot be built; the second value says why."""
    try:
        return prepare_with_pairs(bars, pairs, market, market_order, reference_compat, causal, limit, **kw), None
    except Exception as error:  # noqa: BLE001 - the caller gets the reason
        return prepare_features(bars, market, market_order, **kw), str(error)


def leakage_report(features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Five checks against future values: (check, column, ok).

    The tail of each target must be unknown, times must grow with the row number, and
    no feature may have a name, or come from a list, that reads ahead.
    """
    names = list(names) if names is not None else [
        n for n in features.columns if n not in ("asset", "other_asset", "datetime", "_rn", *registry.TARGETS)
    ]
    sizes = features.groupBy("asset").agg((F.max("_rn") + 1).alias("_n"))
    tail = features.select("asset", "_rn", *[f"target_{h}" for h in settings.HORIZONS])
    # By (series, chunk), so that a long series is not one join key.
    size = settings.CHUNK_ROWS
    parts = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size))))
    tail = tail.withColumn("_part", F.floor(F.col("_rn") / size)).join(parts, ["asset", "_part"])
    known = [
        F.sum(((F.col("_rn") >= F.col("_n") - n) & F.col(f"target_{h}").isNotNull()).cast("long")).alias(f"target_{h}")
        for h, n in settings.HORIZONS.items()
    ]
    tails = tail.agg(*known).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("target tail unknown").alias("check"), F.lit(f"target_{h}").alias("column"),
                        (F.col(f"target_{h}") == 0).alias("ok"),
                    )
                    for h in settings.HORIZONS
                ]
            )
        )
    )
    series = chunked(features.select("asset", "datetime", "_rn"), halo_rows=256, numbered=True)
    back = series.with_columns({"_back": F.coalesce(series.lag("datetime") >= F.col("datetime"), F.lit(False))})
    order = back.df.where("_own").agg(F.sum(F.col("_back").cast("long")).alias("n")).select(
        F.lit("time order").alias("check"), F.lit("datetime").alias("column"), (F.col("n") == 0).alias("ok")
    )
    by_name = [("feature name", n, not any(word in n for word in registry.SUSPICIOUS)) for n in names]
    by_name += [("no look-ahead column", n, n not in registry.FUTURE) for n in names if "other" in n]
    by_name += [("lag column looks back", n, "to_other" not in n) for n in names if "_lag_" in n]
    named = features.sparkSession.createDataFrame(by_name, "check string, column string, ok boolean")
    return tails.unionByName(order).unionByName(named)
