"""Series cut into chunks, so that no series has to fit into one task.

Every series (one per key) is numbered by time and cut into chunks of ``chunk_rows``
rows. A chunk also gets the last ``halo_rows`` rows before it (and, for forward
looking columns, the first ``lead_rows`` rows after it), so that every row frame of up
to that length is complete inside its chunk. All window expressions then share one
partitioning ``(keys, _chunk)`` and one ordering ``(_block, _i)``: one exchange and one
sort serve all features, and a series that holds a third of all rows is still spread
over many tasks. Values with unlimited memory (running sums, carry-forward) use a small
table with one row per chunk.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidebar import settings
from tidebar.functions.clock import seconds
from tidebar.functions.scalars import ColumnOrName, c

MARKS = ("_rn", "_chunk", "_own", "_block", "_i")

# Rows that one frame adds up as they are, and the block of longer sums.
SHORT_ROWS, SUM_BLOCK = 32, 24


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "datetime",
    slot_seconds: int = settings.SLOT_SECONDS,
    out: str = "_rn",
) -> DataFrame:
    """Position of each row in its series, from 0, without one task per series.

    Rows are numbered inside time slots; a table of slot sizes gives each slot its offset.
    """
    keys = list(keys)
    slotted = df.withColumn("_slot", F.floor(seconds(order) / F.lit(slot_seconds)))
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        slotted.withColumn("_at", F.row_number().over(in_slot) - F.lit(1))
        .join(offsets, [*keys, "_slot"])
        .withColumn(out, F.col("_offset") + F.col("_at"))
        .drop("_slot", "_at", "_offset")
    )


_WORD = re.compile(r"[A-Za-z_]\w*")


class Series:
    """A chunked frame of series and the windows over it.

    New columns are collected and added in as few passes as their dependencies allow,
    so independent features share one window operator, however many calls added them.
    Each comes as late as its readers allow: long chains run on narrow rows, and the many
    plain features join in the last pass.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        chunk_rows: int,
        halo_rows: int,
        scattered: bool = False,
        _plan: "_Levels | None" = None,
        lead_rows: int = 0,
    ):
        self.keys, self.chunk_rows, self.halo_rows, self.lead_rows = tuple(keys), chunk_rows, halo_rows, lead_rows
        self._base, self._scattered = df, scattered
        self._plan, self._built = _plan or _Levels(), None

    @property
    def df(self) -> DataFrame:
        """The frame with everything that was added."""
        if self._built is None:
            out, levels = self._base, self._plan.latest()
            if levels and self._scattered:
                # Chunks together first: a window by block alone would spread them again.
                out = out.repartition(*self.part)
            for level in levels:
                out = out.withColumns(level)
            self._built = out.drop(*sorted(self._plan.dropped)) if self._plan.dropped else out
        return self._built

    @property
    def part(self) -> list[str]:
        return [*self.keys, "_chunk"]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy("_block", "_i")

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def _back(self, rows: int) -> int:
        """Refuses a look at rows that a chunk does not hold, instead of cutting it short."""
        if rows > self.halo_rows:
            raise ValueError(f"{rows} rows back need a halo of that length; it has {self.halo_rows}")
        return rows

    def _ahead(self, rows: int) -> int:
        if rows > self.lead_rows:
            raise ValueError(f"{rows} rows ahead need lead_rows of that length; there are {self.lead_rows}")
        return rows

    def last_rows(self, k: int) -> WindowSpec:
        self._back(k - 1)
        return self.w.rowsBetween(-(k - 1), 0)

    # -- adding columns -------------------------------------------------------------

    def _with_plan(self, plan: "_Levels") -> "Series":
        return Series(self._base, self.keys, self.chunk_rows, self.halo_rows, self._scattered, plan, self.lead_rows)

    def with_columns(self, columns: dict[str, Column]) -> "Series":
        """Add (or replace) columns. All of them read the frame as it is before."""
        return self._with_plan(self._plan.adding(columns))

    def drop(self, *names: str) -> "Series":
        return self._with_plan(self._plan.dropping(names))

    def with_df(self, df: DataFrame) -> "Series":
        return Series(df, self.keys, self.chunk_rows, self.halo_rows, lead_rows=self.lead_rows)

    def rows(self, *columns: str, keep_position: bool = False) -> DataFrame:
        """The rows themselves, without halo and without the marks."""
        own = self.df.where("_own")
        if columns:
            return own.select(*columns)
        marks = [m for m in MARKS if m != "_rn" or not keep_position]
        return own.drop(*marks)

    # -- window expressions ---------------------------------------------------------
    # Columns named by text become one SQL expression each: building a plan of hundreds
    # of window expressions call by call takes longer than running it on small data.

    def over(self, rows: str = "") -> str:
        part = ", ".join(f"`{n}`" for n in self.part)
        return f"OVER (PARTITION BY {part} ORDER BY `_block`, `_i` {rows})"

    def over_last(self, k: int) -> str:
        self._back(k - 1)
        return self.over(f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW")

    def lag(self, x: ColumnOrName, n: int = 1) -> Column:
        self._back(n)
        if isinstance(x, str):
            return F.expr(f"lag(`{x}`, {n}) {self.over()}")
        return F.lag(x, n).over(self.w)

    def lead(self, x: ColumnOrName, n: int = 1) -> Column:
        self._ahead(n)
        if isinstance(x, str):
            return F.expr(f"lead(`{x}`, {n}) {self.over()}")
        return F.lead(x, n).over(self.w)

    def diff(self, x: ColumnOrName, n: int = 1) -> Column:
        self._back(n)
        if isinstance(x, str):
            return F.expr(f"`{x}` - lag(`{x}`, {n}) {self.over()}")
        return x - self.lag(x, n)

    def change(self, x: ColumnOrName, n: int = 1) -> Column:
        """Relative change against ``n`` rows before. Use a padded column for the
        variant that carries the last known value over gaps."""
        self._back(n)
        if isinstance(x, str):
            return F.expr(f"try_divide(`{x}`, lag(`{x}`, {n}) {self.over()}) - 1.0D")
        return F.try_divide(x, self.lag(x, n)) - F.lit(1.0)

    def full(self, x: ColumnOrName, k: int, function: str) -> Column:
        """An aggregate, only where all ``k`` rows of the frame have ``x``."""
        if isinstance(x, str):
            frame = self.over_last(k)
            return F.expr(f"CASE WHEN count(`{x}`) {frame} = {k} THEN {function}(`{x}`) {frame} END")
        frame = self.last_rows(k)
        return F.when(F.count(x).over(frame) == k, F.call_function(function, x).over(frame))

    def mean(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "avg")

    def total(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "sum")

    def std(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "stddev_samp")

    def pop_std(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "stddev_pop")

    def highest(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "max")

    def lowest(self, x: ColumnOrName, k: int) -> Column:
        return self.full(x, k, "min")

    def corr(self, a: str, b: str, k: int) -> Column:
        """Correlation over ``k`` complete pairs; NULL when one side is constant."""
        frame = self.over_last(k)
        return F.expr(
            f"CASE WHEN count(CASE WHEN `{a}` IS NOT NULL AND `{b}` IS NOT NULL THEN 1 END) {frame} = {k} "
            f"THEN try_divide(covar_pop(`{a}`, `{b}`) {frame}, "
            f"stddev_pop(`{a}`) {frame} * stddev_pop(`{b}`) {frame}) END"
        )

    def carried(self, x: ColumnOrName) -> Column:
        """Last known value inside the chunk (see ``carry_forward`` for whole series)."""
        if isinstance(x, str):
            frame = self.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
            return F.expr(f"last(`{x}`, true) {frame}")
        return F.last(x, ignorenulls=True).over(self.so_far)

    # -- long sums: a few lookups per row instead of k -------------------------------

    def long_sums(self, columns: dict[str, tuple[str, int]]) -> "Series":
        """Sums over long frames, ``{out: (column, k)}``, from sums over short ones.

        A frame of k rows is a run of whole blocks of 24 rows and the rest before them; many
        blocks are added up in groups first. Everything is added and nothing subtracted, so a
        huge value is gone when its frame is, and leaves no error in later sums.
        """
        frame = self.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        counts = {f"_n_{x}": F.expr(f"count(`{x}`) {frame}") for x in {col for col, _ in columns.values()}}
        short: dict[str, Column] = {}
        grouped: dict[str, Column] = {}
        sums: dict[str, Column] = {}

        def back(name: str, rows: int) -> str:
            return f"lag(`{name}`, {rows}) {self.over()}" if rows else f"`{name}`"

        def short_sum(x: str, rows: int) -> str:
            name = f"_s{rows}_{x}"
            short[name] = F.expr(f"sum(coalesce(`{x}`, 0.0D)) {self.over_last(rows)}")
            return name

        for out, (x, k) in columns.items():
            self._back(k)
            parts, at = [], 0
            if k <= SHORT_ROWS:
                parts, at = [back(short_sum(x, k), 0)], k
            else:
                blocks = k // SUM_BLOCK
                one = short_sum(x, SUM_BLOCK)
                group = 1 + int(blocks**0.5) if blocks > 9 else blocks + 1
                while blocks >= group:
                    name = f"_s{SUM_BLOCK * group}_{x}"
                    grouped[name] = F.expr(" + ".join(back(one, SUM_BLOCK * i) for i in range(group)))
                    parts.append(back(name, at))
                    at, blocks = at + SUM_BLOCK * group, blocks - group
                for _ in range(blocks):
                    parts.append(back(one, at))
                    at += SUM_BLOCK
                if k > at:
                    parts.append(back(short_sum(x, k - at), at))
            count = f"`_n_{x}` - coalesce(lag(`_n_{x}`, {k}) {self.over()}, 0)"
            sums[out] = F.expr(f"CASE WHEN {count} = {k} THEN {' + '.join(parts)} END")
        helpers = [*counts, *short, *grouped]
        started = self.with_columns(counts | short)
        if grouped:
            started = started.with_columns(grouped)
        return started.with_columns(sums).drop(*helpers)

    # -- memory without limit --------------------------------------------------------

    def running_sum(self, x: ColumnOrName, out: str) -> "Series":
        """Sum of ``x`` from the start of the series."""
        valued = self.with_columns({"_x": F.coalesce(c(x), F.lit(0.0))})
        chunks = valued.df.groupBy(*self.part).agg(
            F.sum(F.when(F.col("_own"), F.col("_x"))).alias("_own_sum"),
            F.sum(F.when(~F.col("_own"), F.col("_x"))).alias("_halo_sum"),
        )
        before = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        base = chunks.select(
            *self.part,
            (
                F.coalesce(F.sum("_own_sum").over(before), F.lit(0.0))
                - F.coalesce(F.col("_halo_sum"), F.lit(0.0))
            ).alias("_base"),
        )
        joined = valued.with_df(valued.df.join(base, self.part))
        total = F.col("_base") + F.sum("_x").over(joined.so_far)
        return joined.with_columns({out: total}).drop("_x", "_base")

    def carry_forward(self, columns: dict[str, str], back_fill: bool = False) -> "Series":
        """Last known value since the start of the series, ``{out: column}``.

        ``back_fill`` also gives rows before the first known value that first value.
        """
        sources = sorted(set(columns.values()))
        # Rows of a chunk that its successor does not also see as halo.
        reach = (F.col("_chunk") + 1) * self.chunk_rows - self.halo_rows
        position = F.when(F.col("_own"), F.col("_rn"))
        aggs = []
        for s in sources:
            known = F.when(c(s).isNotNull(), position)
            aggs.append(F.max_by(c(s), known).alias(f"_whole_{s}"))
            aggs.append(F.max_by(c(s), F.when(F.col("_rn") < reach, known)).alias(f"_head_{s}"))
            if back_fill:
                aggs.append(F.min_by(c(s), known).alias(f"_start_{s}"))
        chunks = self.df.groupBy(*self.part).agg(*aggs)
        by_chunk = Window.partitionBy(*self.keys).orderBy("_chunk")
        older = by_chunk.rowsBetween(Window.unboundedPreceding, -2)
        every = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        bases = [
            F.coalesce(
                F.lag(f"_head_{s}").over(by_chunk),
                F.last(f"_whole_{s}", ignorenulls=True).over(older),
            ).alias(f"_base_{s}")
            for s in sources
        ]
        if back_fill:
            bases += [
                F.first(f"_start_{s}", ignorenulls=True).over(every).alias(f"_first_{s}")
                for s in sources
            ]
        joined = self.with_df(self.df.join(chunks.select(*self.part, *bases), self.part))
        filled = {}
        for out, s in columns.items():
            options = [joined.carried(s), F.col(f"_base_{s}")]
            if back_fill:
                options.append(F.col(f"_first_{s}"))
            filled[out] = F.coalesce(*options)
        helpers = [f"_base_{s}" for s in sources] + [f"_first_{s}" for s in sources if back_fill]
        return joined.with_columns(filled).drop(*helpers)


class _Levels:
    """New columns by level; a level reads what the levels before it made."""

    def __init__(self, levels=(), made=None, read=None, dropped=frozenset()):
        self.levels: tuple[dict[str, Column], ...] = tuple(levels)
        self.made: dict[str, int] = made or {}
        self.read: dict[str, int] = read or {}
        self.dropped = frozenset(dropped)

    def adding(self, columns: dict[str, Column]) -> "_Levels":
        levels = [dict(level) for level in self.levels]
        words = {name: set(_WORD.findall(str(column))) for name, column in columns.items()}
        places = {}
        for name, seen in words.items():
            places[name] = 1 + max((self.made[r] for r in seen if r in self.made), default=-1)
        for name in places:
            # A replaced column comes after the old one and no earlier than its readers.
            if name in self.made:
                places[name] = max(places[name], self.made[name] + 1)
            readers = [places[other] for other in places if other != name and name in words[other]]
            places[name] = max(places[name], self.read.get(name, -1), *readers)
        read = dict(self.read)
        for name, seen in words.items():
            for r in seen:
                read[r] = max(read.get(r, -1), places[name])
        for name, place in places.items():
            while len(levels) <= place:
                levels.append({})
            levels[place][name] = columns[name]
        return _Levels(levels, self.made | places, read, self.dropped - set(columns))

    def latest(self) -> list[dict[str, Column]]:
        """The same columns, each moved to the last level before its first reader.

        Names made twice, or read by their own definition, stay where they are, and so
        does what reads them.
        """
        made = [(place, name, column) for place, level in enumerate(self.levels) for name, column in level.items()]
        words = {id(column): set(_WORD.findall(str(column))) for _, _, column in made}
        names = [name for _, name, _ in made]
        twice = {name for name in names if names.count(name) > 1}
        twice |= {name for _, name, column in made if name in words[id(column)]}
        out: list[dict[str, Column]] = [{} for _ in self.levels]
        first_reader: dict[str, int] = {}
        for place, name, column in reversed(made):
            seen = words[id(column)]
            if name not in twice and not seen & twice:
                place = first_reader.get(name, len(out)) - 1
            out[place][name] = column
            for r in seen:
                first_reader[r] = min(first_reader.get(r, len(out)), place)
        return [level for level in out if level]

    def dropping(self, names: Sequence[str]) -> "_Levels":
        return _Levels(self.levels, self.made, self.read, self.dropped | set(names))


def chunked(
    df: DataFrame,
    keys: Sequence[str] = ("asset",),
    order: str = "datetime",
    *,
    lead_rows: int = 0,
    chunk_rows: int = settings.CHUNK_ROWS,
    halo_rows: int = settings.HALO_ROWS,
    numbered: bool = False,
) -> Series:
    """Cut the series in ``df`` into overlapping chunks (see the module text)."""
    if halo_rows > chunk_rows or lead_rows > chunk_rows:
        raise ValueError("a chunk must be at least as long as its halo")
    if chunk_rows % settings.BLOCK_ROWS or halo_rows % settings.BLOCK_ROWS:
        raise ValueError(f"chunk_rows and halo_rows must be multiples of {settings.BLOCK_ROWS}")
    rows = df if numbered else number_rows(df, keys, order)
    home = F.floor(F.col("_rn") / F.lit(chunk_rows))
    place = F.col("_rn") % F.lit(chunk_rows)
    copies = F.array_compact(
        F.array(
            home,
            F.when(place >= chunk_rows - halo_rows, home + 1),
            F.when((place < lead_rows) & (home > 0), home - 1),
        )
    )
    cut = (
        rows.withColumn("_chunk", F.explode(copies))
        .withColumn("_own", F.col("_chunk") == home)
        .withColumn("_block", F.floor(F.col("_rn") / F.lit(settings.BLOCK_ROWS)))
        .withColumn("_i", (F.col("_rn") % F.lit(settings.BLOCK_ROWS)).cast("int"))
    )
    return Series(cut, keys, chunk_rows, halo_rows, scattered=True, lead_rows=lead_rows)
