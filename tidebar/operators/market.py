"""Market prints next to bars: pivot, carry forward, join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidebar import settings
from tidebar.functions.scalars import ColumnOrName, c, div
from tidebar.operators.series import Series, chunked
from tidebar.session import staged


def pivot_last(
    market: DataFrame, symbols: dict[str, str], order: ColumnOrName, value: str = "Close"
) -> DataFrame:
    """One row per time, one column per symbol: the last print at that time."""
    last = F.max_by(value, c(order))
    wide = market.groupBy("datetime").pivot("symbol", list(symbols)).agg(last)
    return wide.select("datetime", *[F.col(f"`{s}`").alias(n) for s, n in symbols.items()])


def carried_prints(pivot: DataFrame, names: list[str]) -> DataFrame:
    """Each symbol's last known print at every time of the pivot."""
    series = chunked(pivot, keys=())
    return series.carry_forward({n: n for n in names}).rows("datetime", *names)


def join_market(
    bars: DataFrame,
    market: DataFrame,
    order: ColumnOrName,
    symbols: dict[str, str] = settings.MARKET_SYMBOLS,
    how: str = "exact",
    lead_rows: int = 0,
) -> Series:
    """Bars with one price column per symbol, carried over bars without a print.

    ``exact`` joins prints made at the very time of a bar; ``asof`` takes the last print
    at or before each bar, whatever its time.
    """
    names = list(symbols.values())
    pivot = staged(pivot_last(market, symbols, order), "market-pivot")
    if how == "asof":
        times = bars.select("datetime").distinct()
        pivot = staged(pivot.join(times, "datetime", "full"), "market-grid")
    elif how != "exact":
        raise ValueError("how is 'exact' or 'asof'")
    prints = carried_prints(pivot, names)
    joined = staged(bars.join(prints, "datetime", "left"), "bars-market")
    return chunked(joined, lead_rows=lead_rows).carry_forward({n: n for n in names})


def add_market_features(s: Series, names: tuple[str, ...] = tuple(settings.MARKET_SYMBOLS.values())) -> Series:
    """Rolling correlation with, and price relative to, every symbol."""
    return s.with_columns(
        {f"corr_{n}": s.corr("price", n, 24) for n in names}
        | {f"ratio_{n}": div("price", n) for n in names}
    )
