"""Exponentially weighted means as window sums.

A weighted mean with decay ``a = 1 - alpha`` obeys ``s[t] = a * s[t-1] + x[t]``. Inside a
block of ``BLOCK_ROWS`` rows that is a running sum of ``x * a**-i`` times ``a**i``; earlier
blocks enter through their end values, weighted by powers of ``a``. What lies further back
than the halo weighs less than half a unit in the last place of a double, which is why a
chunk needs no more than its halo. A slower decay than the halo allows is refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tidebar import settings
from tidebar.operators.series import Series

_NEGLIGIBLE = 2.0**-56


@dataclass(frozen=True)
class Ewm:
    """One weighted mean: ``adjusted`` weighs all values alike; otherwise the first known
    value counts whole and later ones ``alpha``. Missing values have no weight, and the
    weights of older ones go on falling over the gap."""

    column: str
    alpha: float
    adjusted: bool = True

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha

    @property
    def blocks_back(self) -> int:
        rows = math.log(_NEGLIGIBLE) / math.log(self.decay)
        return math.ceil(rows / settings.BLOCK_ROWS)

    @staticmethod
    def span(column: str, span: int, **kw) -> "Ewm":
        return Ewm(column, 2.0 / (span + 1.0), **kw)


def add_ewm(series: Series, specs: dict[str, Ewm]) -> Series:
    """Add ``{out: spec}`` in three window passes, whatever the number of specs."""
    size = settings.BLOCK_ROWS
    parts: dict[str, tuple[Ewm, str]] = {}
    earlier_known: dict[str, Column] = {}
    for out, spec in specs.items():
        if spec.blocks_back * size > series.halo_rows or spec.decay**size < 1e-280:
            raise ValueError(f"{out}: alpha {spec.alpha} does not fit a halo of {series.halo_rows} rows")
        x = f"`{spec.column}`"
        weight = "1.0D"
        if not spec.adjusted:
            # a chunk's first known value in its halo counts whole, too: by its own rows that is forgotten
            earlier_known[f"_k_{out}"] = F.expr(f"count({x}) {series.over('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}")
            weight = f"CASE WHEN `_k_{out}` = 0 THEN 1.0D ELSE {spec.alpha!r}D END"
        parts[f"_p_{out}"] = (spec, f"coalesce({x} * {weight}, 0.0D)")
        parts[f"_q_{out}"] = (spec, f"CASE WHEN {x} IS NULL THEN 0.0D ELSE {weight} END")

    if earlier_known:
        series = series.with_columns(earlier_known)
    names = ", ".join(f"`{n}`" for n in series.part)
    in_block = (
        f"OVER (PARTITION BY {names}, `_block` ORDER BY `_i` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    local = series.with_columns(
        {
            name: F.expr(f"sum({x} * pow({spec.decay!r}D, -`_i`)) {in_block} * pow({spec.decay!r}D, `_i`)")
            for name, (spec, x) in parts.items()
        }
    )
    earlier = series.over("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    ends = local.with_columns(
        {
            f"_e{name}": F.expr(f"last(CASE WHEN `_i` = {size - 1} THEN `{name}` END, true) {earlier}")
            for name in parts
        }
    )
    sums = {}
    for name, (spec, _) in parts.items():
        back = [f"coalesce(`_e{name}`, 0.0D)"]
        for k in range(1, spec.blocks_back):
            weight = spec.decay ** (k * size)
            back.append(f"coalesce(lag(`_e{name}`, {k * size}) {series.over()}, 0.0D) * {weight!r}D")
        sums[f"_t{name}"] = F.expr(f"`{name}` + ({' + '.join(back)}) * pow({spec.decay!r}D, `_i` + 1)")
    summed = ends.with_columns(sums)
    result = {}
    for out in specs:
        result[out] = F.expr(f"try_divide(`_t_p_{out}`, `_t_q_{out}`)")
    helpers = [n for name in parts for n in (name, f"_e{name}", f"_t{name}")]
    return summed.with_columns(result).drop(*helpers, *earlier_known)
