"""Deviations and correlations over long row frames.

Spark evaluates a sliding frame from scratch for every row, which for k rows costs k
steps. Here the rows are cut into blocks of k. Any frame of k rows is the tail of one
block and the head of the next, so two running aggregates per block (one from its
start, one from its end) give every frame by merging two partial results, in constant
time per row. Unlike differences of running sums, merging loses no digits when a series
has outliers or a strong trend.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tidebar.operators.series import Series

_ONE = ("n", "mean", "var", "low", "high")


@dataclass(frozen=True)
class LongFrames:
    """What to compute over ``k`` rows: ``{out: column}`` and ``{out: (a, b)}``.

    Every result needs ``k`` known values (pairs); a correlation is NULL when one side
    is constant.
    """

    k: int
    stds: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    corrs: dict[str, tuple[str, str]] = field(default_factory=dict)


def _partial(spec: LongFrames, frame: str, mark: str) -> dict[str, str]:
    singles = sorted({*spec.stds.values(), *spec.means.values(), *(x for ab in spec.corrs.values() for x in ab)})
    out = {}
    for s in singles:
        parts = ("count", "avg", "var_pop", "min", "max")
        out |= {f"_{mark}_{part}_{s}": f"{f}(`{s}`) {frame}" for part, f in zip(_ONE, parts)}
    for a, b in sorted(set(spec.corrs.values())):
        out[f"_{mark}_cov_{a}_{b}"] = f"covar_pop(`{a}`, `{b}`) {frame}"
    return out


def add_long_frames(series: Series, spec: LongFrames) -> Series:
    """Add the results of one frame length."""
    k = spec.k
    part = ", ".join(f"`{n}`" for n in (*series.part, "_kb"))
    reach = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    head = _partial(spec, f"OVER (PARTITION BY {part} ORDER BY `_rn` {reach})", "h")
    tail = _partial(spec, f"OVER (PARTITION BY {part} ORDER BY `_rn` DESC {reach})", "t")
    cut = series.with_columns({"_kb": F.expr(f"floor(`_rn` / {k})")})
    cut = cut.with_columns({n: F.expr(e) for n, e in tail.items()})
    cut = cut.with_columns({n: F.expr(e) for n, e in head.items()})
    # The tail of the block before, seen k - 1 rows ago; none where a block is complete.
    before = f"CASE WHEN `_rn` % {k} <> {k - 1} THEN lag(`{{}}`, {k - 1}) {series.over()} END"
    cut = cut.with_columns({n: F.expr(before.format(n)) for n in tail})

    # Both partial results merged: sizes, means, sums of squares, and the flat-frame test.
    sql: dict[str, str] = {}
    for s in sorted({n.split("_n_", 1)[1] for n in head if n.startswith("_h_n_")}):
        sql[f"_nt_{s}"] = f"coalesce(`_t_n_{s}`, 0)"
        sql[f"_all_{s}"] = f"`_h_n_{s}` + coalesce(`_t_n_{s}`, 0)"
        sql[f"_gap_{s}"] = f"coalesce(`_t_mean_{s}`, `_h_mean_{s}`) - `_h_mean_{s}`"
        sql[f"_flat_{s}"] = f"least(`_h_low_{s}`, `_t_low_{s}`) = greatest(`_h_high_{s}`, `_t_high_{s}`)"
    cut = cut.with_columns({n: F.expr(e) for n, e in sql.items()})

    def square(s: str) -> str:
        share = f"`_h_n_{s}` * `_nt_{s}` / `_all_{s}`"
        return (
            f"CASE WHEN `_flat_{s}` THEN 0.0D ELSE `_h_var_{s}` * `_h_n_{s}` "
            f"+ coalesce(`_t_var_{s}`, 0.0D) * `_nt_{s}` + `_gap_{s}` * `_gap_{s}` * {share} END"
        )

    out = {}
    for name, s in spec.stds.items():
        out[name] = f"CASE WHEN `_all_{s}` = {k} THEN sqrt({square(s)} / {k - 1}) END"
    for name, s in spec.means.items():
        out[name] = f"CASE WHEN `_all_{s}` = {k} THEN `_h_mean_{s}` + `_gap_{s}` * `_nt_{s}` / {k} END"
    for name, (a, b) in spec.corrs.items():
        cov = (
            f"`_h_cov_{a}_{b}` * `_h_n_{a}` + coalesce(`_t_cov_{a}_{b}`, 0.0D) * `_nt_{a}` "
            f"+ `_gap_{a}` * `_gap_{b}` * `_h_n_{a}` * `_nt_{a}` / `_all_{a}`"
        )
        out[name] = (
            f"CASE WHEN `_all_{a}` = {k} AND `_all_{b}` = {k} "
            f"THEN try_divide({cov}, sqrt({square(a)}) * sqrt({square(b)})) END"
        )
    done = cut.with_columns({n: F.expr(e) for n, e in out.items()})
    return done.drop("_kb", *head, *tail, *sql)
