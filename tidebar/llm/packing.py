"""Mixture-controlled packing by deficit round robin over source queues.

Every source is a queue of token ids. Each window of 4096 takes from each queue its share of
the target mixture; what rounding leaves over is given out by the largest deficits, and
deficits go on into the next window. Without given targets the mixture is the corpus's own,
so all queues run dry together; with targets, the sources left share on when one runs dry.

The queues are cut into lanes of 128 windows that tasks fill independently. A lane begins
where the round robin stands by then: the number of ids granted to a queue by then is
computed in exact integers from the queues' totals, so deficits carry across partitions too,
and every lane but a mixture's last is a whole number of windows. What is left at the end of
a mixture (less than one window) becomes sequences of powers of two, which need no padding.

A queue with a third of all rows is spread over all lanes like every other. The driver holds
the totals of at most ``queues`` sources: the largest have queues of their own, all others
share one. No row is dropped.

Defined results: a null or empty text is the end id alone; a null source is a queue of its
own; repeated rows are documents of their own; an empty table gives no pieces; columns
besides doc_id, text and source are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidebar.llm import tokens
from tidebar.llm.base import map_batches, texts
from tidebar.session import staged

WINDOW = 4096
LANE_WINDOWS = 128
QUEUES = 256  # below the root of half a lane's ids, which keeps lane starts in order


class Phase:
    """A stretch of the packing in which each queue gives a fixed number of ids."""

    def __init__(self, starts: list[int], sizes: list[int], window: int, lane_windows: int, first_lane: int, first_sequence: int):
        self.starts, self.sizes, self.window, self.lane_windows = starts, sizes, window, lane_windows
        self.total = sum(sizes)
        self.first_lane, self.first_sequence = first_lane, first_sequence
        self.lanes = max(1, self.total // (window * lane_windows))  # the last lane has what is left, too
        self.largest = max(range(len(sizes)), key=lambda q: (sizes[q], -q))
        self.known: dict[int, list[int]] = {}

    def granted(self, lane: int) -> list[int]:
        """The ids that each queue has given before a lane begins."""
        if lane >= self.lanes:
            return self.sizes
        if lane not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            ids = lane * self.lane_windows * self.window
            out = [s * ids // self.total for s in self.sizes]
            out[self.largest] += ids - sum(out)
            self.known[lane] = out
        return self.known[lane]

    def lane_of(self, queue: int, at: int) -> int:
        """The lane that takes a queue's id at a place of this phase."""
        size = self.sizes[queue]
        lane = min(self.lanes - 1, at * self.total // (size * self.lane_windows * self.window))
        while self.granted(lane)[queue] > at:
            lane -= 1
        while lane + 1 < self.lanes and self.granted(lane + 1)[queue] <= at:
            lane += 1
        return lane


class Mixture:
    """The phases of a packing, from the queues' totals and target weights."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, lane_windows: int = LANE_WINDOWS):
        self.phases: list[Phase] = []
        left, given = list(totals), [0] * len(totals)
        weights = [Fraction(w) for w in (weights or totals)]
        lane = sequence = 0
        while sum(left):
            active = [q for q in range(len(left)) if left[q] and weights[q] > 0]
            if not active:  # only queues without a target are left: as they come
                weights = [Fraction(n) for n in left]
                continue
            rounds = min(Fraction(left[q]) / weights[q] for q in active)
            sizes = [int(rounds * weights[q]) if q in active else 0 for q in range(len(left))]
            phase = Phase(list(given), sizes, window, lane_windows, lane, sequence)
            self.phases.append(phase)
            lane += phase.lanes
            sequence += phase.total // window + window.bit_length()  # room for the sequences of the rest
            left = [a - b for a, b in zip(left, sizes)]
            given = [a + b for a, b in zip(given, sizes)]

    def cuts(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(lane, place in the run, length) of the parts of a run of a queue's ids."""
        end = start + length
        for p in self.phases:
            lo, hi = max(start, p.starts[queue]), min(end, p.starts[queue] + p.sizes[queue])
            while lo < hi:
                lane = p.lane_of(queue, lo - p.starts[queue])
                stop = min(hi, p.starts[queue] + p.granted(lane + 1)[queue])
                yield p.first_lane + lane, lo - start, stop - lo
                lo = stop

    def phase_of(self, lane: int) -> Phase:
        return next(p for p in reversed(self.phases) if p.first_lane <= lane)


def round_robin(sizes: list[int], window: int) -> Iterator[tuple[int, list[int]]]:
    """(sequence size, ids from each queue) for a lane whose queues hold ``sizes`` ids."""
    total, given = sum(sizes), [0] * len(sizes)
    ends = list(range(window, total + 1, window))
    at = ends[-1] if ends else 0
    for bit in reversed(range((total - at).bit_length())):  # the rest, in powers of two
        if (total - at) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    before = 0
    for end in ends:
        take = [max(0, s * end // total - g) for s, g in zip(sizes, given)]
        short = end - before - sum(take)
        if short:  # by deficit: what a queue is owed beyond what it has given
            owed = sorted(((s * end - total * (g + t), -q) for q, (s, g, t) in enumerate(zip(sizes, given, take))), reverse=True)
            for _, q in owed[: max(0, short)]:
                take[-q] += 1
            for _, q in owed[::-1]:  # a queue that is ahead made the others' shares too large
                back = min(take[-q], -short) if short < 0 else 0
                take[-q] -= back
                short += back
        given = [g + t for g, t in zip(given, take)]
        yield end - before, take
        before = end


TOKENS = "part int, source string, before long, doc_id long, n long, ids binary"
PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
          "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string()}


def token_queues(docs: DataFrame, tokenizer: str, end_id: int, by: str = "source") -> DataFrame:
    """One row per document: its ids, and its place among its task's rows of the same source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        part, given = TaskContext.get().partitionId(), {}
        for b in batches:
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            sizes, sources, before = [len(x) // enc.width for x in ids], b.column(2).to_pylist(), []
            for s, n in zip(sources, sizes):
                before.append(given.get(s, 0))
                given[s] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), b.column(2), pa.array(before, pa.int64()), b.column(0), pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.binary())], names=["part", "source", "before", "doc_id", "n", "ids"])

    # a null source is told from an empty one
    rows = texts(docs, by).withColumn("queue", F.when(F.col(by).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(by).cast("string"))))
    return map_batches(rows.select("doc_id", "text", "queue"), run, TOKENS)


def pack(docs: DataFrame, tokenizer: str, end_id: int, targets: dict[str, float] | None = None, by: str = "source", window: int = WINDOW,
         lane_windows: int = LANE_WINDOWS, queues: int = QUEUES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    if 2 * queues * queues > window * lane_windows:
        raise ValueError("too many queues for lanes of this size")
    rows = staged(token_queues(docs, tokenizer, end_id, by), "token-queues")
    width = tokens.encoder(tokenizer).width
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = staged(sums, "queue-parts")
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(queues - 1).collect()  # bounded
    names = [r["source"] for r in largest]
    everything = sums.agg(F.sum("n")).first()[0] or 0
    totals = [*(r["n"] for r in largest), everything - sum(r["n"] for r in largest)]
    weights = None
    if targets is not None:
        known = {f"={k}": v for k, v in targets.items()}
        weights = [*(known.get(n, 0.0) for n in names), 0.0]
    mixture = Mixture(totals, weights, window, lane_windows)
    queue = F.lit(len(names))
    if names:
        queue = F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.col("source")], queue)
    # where each task's rows of a source begin in its queue
    running = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = staged(sums.withColumn("queue", queue).withColumn("begin", F.coalesce(F.sum("n").over(running), F.lit(0)))
                    .select("source", "part", "queue", "begin"), "queue-begins")
    placed = rows.join(begins, ["source", "part"]).select(
        "queue", (F.col("begin") + F.col("before")).alias("at"), "doc_id", "n", "source", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, at, doc_id, n, source, ids in zip(*(b.column(i).to_pylist() for i in range(6))):
                for lane, start, length in mixture.cuts(q, at, n):
                    out.append((lane, q, at + start, doc_id, start, n, source[1:] if source != "-" else None, ids[start * width : (start + length) * width]))
            columns = zip(*out) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary()))],
                names=["lane", "queue", "at", "doc_id", "start", "n", "source", "ids"])

    lanes = map_batches(placed, cut, "lane long, queue int, at long, doc_id long, start long, n long, source string, ids binary")
    lanes = lanes.repartition("lane").sortWithinPartitions("lane", "queue", "at")

    def fill(lane: int, held: list[list[tuple]]) -> pa.RecordBatch:
        """Pieces of one lane, whose queues hold runs in order."""
        phase = mixture.phase_of(lane)
        sequence = phase.first_sequence + (lane - phase.first_lane) * lane_windows
        sizes = [sum(len(r[-1]) // width for r in runs) for runs in held]
        place = [(0, 0)] * len(held)  # the run a queue is at, and how much of it is gone
        out = []
        for _, take in round_robin(sizes, window):
            offset = 0
            for q, wanted in enumerate(take):
                while wanted:
                    i, gone = place[q]
                    doc_id, start, n, source, ids = held[q][i]
                    length = min(wanted, len(ids) // width - gone)
                    crc = zlib.crc32(np.frombuffer(ids, f"<u{width}", length, gone * width).astype("<u4"))
                    out.append((doc_id, start + gone, length, crc, n, sequence, offset, source))
                    wanted, offset, gone = wanted - length, offset + length, gone + length
                    place[q] = (i, gone) if gone < len(ids) // width else (i + 1, 0)
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECES.values())], names=list(PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for lane, q, _, doc_id, start, n, source, ids in zip(*(b.column(i).to_pylist() for i in range(8))):
                if lane != now:
                    if now is not None:
                        yield fill(now, held)
                    now, held = lane, [[] for _ in totals]
                held[q].append((doc_id, start, n, source, ids))
        if now is not None:
            yield fill(now, held)

    return map_batches(lanes, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
