"""Nearest row in time within a tolerance, of one source or of several at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.functions.clock import micros

DAY = 86_400_000_000
NO_TIME_SLOTS = 4_096  # probes without a time are spread over so many slots
_LONG_AGO = -(1 << 40)  # no slot of a timestamp lies so far back


@dataclass(frozen=True)
class Facts:
    """Rows to look among: ``values`` as {out: column}, and how far away they may lie.

    ``later_seconds`` moves the rows ahead in time, so that a probe at ``t`` asks for
    what was known at ``t - later_seconds``.
    """

    rows: DataFrame
    ts: str
    values: dict[str, str]
    tolerance_seconds: int
    inclusive: bool = False
    out_ts: str | None = None
    later_seconds: int = 0

    @property
    def limit(self) -> int:
        return self.tolerance_seconds * 1_000_000


def nearest_of_each(probes: DataFrame, sources: Sequence[Facts], *, keys: Sequence[str], probe_ts: str) -> DataFrame:
    """Every probe with the values of its nearest fact of each source, or NULL.

    Nearer than the tolerance (``inclusive``: or exactly at it); of two equally near
    facts the earlier one, of facts at one time the greatest. No pairs are formed: probes
    and the facts of all sources are sorted together inside time slots at least as wide
    as the widest tolerance, and each probe looks at the last fact before and the first
    one after it, source by source. Of the neighbouring slots only their last and first
    facts can matter, so just these are copied over. Probes without a time keep their row
    and find nothing; a fact without a time is no fact.
    """
    keys = list(keys)
    width = max(DAY, *[s.limit for s in sources])
    slot_of = F.floor(F.col("_at") / width)
    names = [f"_fact{i}" for i in range(len(sources))]

    def known(source: Facts, name: str) -> DataFrame:
        # the fact's own time and values; `_at` is the time that it answers for
        rows = source.rows.where(F.col(source.ts).isNotNull())
        rows = rows.withColumn("_at", micros(source.ts) + source.later_seconds * 1_000_000)
        packed = F.struct(F.col("_at").alias("at"), *[F.col(col).alias(out) for out, col in source.values.items()])
        return rows.select(*keys, "_at", slot_of.alias("_slot"), packed.alias(name))

    def union(frames) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    facts = union(known(s, n) for s, n in zip(sources, names))
    ends = facts.groupBy(*keys, "_slot").agg(
        *[F.max(n).alias(f"_latest{n}") for n in names], *[F.min(n).alias(f"_earliest{n}") for n in names])
    copies = [(1, "_latest", n) for n in names] + [(-1, "_earliest", n) for n in names]
    packed = {n: facts.schema[n].dataType for n in names}
    moved = ends.select(*keys, F.inline(F.array(*[
        F.struct(
            (F.col("_slot") + step).alias("_slot"), F.col(f"{end}{n}.at").alias("_at"),
            *[(F.col(f"{end}{n}") if n == m else F.lit(None).cast(packed[m])).alias(m) for m in names])
        for step, end, n in copies]))).where(F.col("_at").isNotNull())
    asked = probes.select(
        *keys, micros(probe_ts).alias("_at"), F.struct(*[F.col(f"`{n}`") for n in probes.columns]).alias("_probe"))
    spread = F.lit(_LONG_AGO) - F.pmod(F.xxhash64("_probe"), F.lit(NO_TIME_SLOTS))
    asked = asked.withColumn("_slot", F.coalesce(slot_of, spread))

    rows = union([facts, moved, asked]).withColumn("_asks", F.col("_probe").isNotNull())
    slot = Window.partitionBy(*keys, "_slot")
    reach = (Window.unboundedPreceding, 0)
    until = slot.orderBy("_at", "_asks", *names).rowsBetween(*reach)
    since = slot.orderBy(F.desc("_at"), "_asks", *names).rowsBetween(*reach)
    found = rows.withColumns({f"_before{n}": F.last(n, ignorenulls=True).over(until) for n in names})
    found = found.withColumns({f"_after{n}": F.last(n, ignorenulls=True).over(since) for n in names}).where("_asks")
    found = found.withColumns({f"_pick{n}": _pick(f"_before{n}", f"_after{n}") for n in names})
    columns = [F.col(f"_probe.`{n}`") for n in probes.columns]
    for source, n in zip(sources, names):
        distance = F.abs(F.col(f"_pick{n}.at") - F.col("_at"))
        near = distance <= source.limit if source.inclusive else distance < source.limit
        columns += [F.when(near, F.col(f"_pick{n}.{out}")).alias(out) for out in source.values]
        if source.out_ts:
            own = F.col(f"_pick{n}.at") - source.later_seconds * 1_000_000
            own = F.timestamp_add("MICROSECOND", own, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
            columns.append(F.when(near, own).alias(source.out_ts))
    return found.select(*columns)


def _pick(before: str, after: str) -> Column:
    back = F.col("_at") - F.col(f"{before}.at")
    ahead = F.col(f"{after}.at") - F.col("_at")
    return F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col(before)).otherwise(F.col(after))


def nearest(
    probes: DataFrame,
    facts: DataFrame,
    *,
    keys: Sequence[str],
    probe_ts: str,
    fact_ts: str,
    values: dict[str, str],
    tolerance_seconds: int,
    inclusive: bool = False,
    out_ts: str | None = None,
) -> DataFrame:
    """``nearest_of_each`` for one source."""
    source = Facts(facts, fact_ts, values, tolerance_seconds, inclusive, out_ts)
    return nearest_of_each(probes, [source], keys=keys, probe_ts=probe_ts)
