"""Token ids as Re-Pair grammars: binary shards with rules, lengths and random access.

Documents are brought into ascending doc_id order, tokenized, and cut into shards of about
half a million ids at document ends. In each shard frequent pairs of neighbouring symbols are
replaced by new symbols, round after round, until no pair is frequent or the rounds are up.
A shard holds its own alphabet, the rules, every symbol's expanded length, and the expanded
position of each 1024th symbol, so a span of ids is decoded without the rest.

Shards are rows of a Parquet table that Spark commits, so a lost task leaves no half files.
A task holds one shard: at most the target size, or one longer document.

Defined results: a null or empty text is the end id alone; a null doc_id comes first and
stays null; repeated rows are documents of their own, one after the other; an empty table
gives an empty file; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebar.llm import tokens
from tidebar.llm.base import map_batches, texts
from tidebar.session import scratch_path, staged

SHARD_IDS = 1 << 19
STEP = 1024
CACHED_PIECES = 1_000_000  # a query of its own leaves its workers room for more than a pipeline's stage has
MAGIC = b"PAIR0001"
_HEAD = struct.Struct("<8s6q")


def _replace(seq: np.ndarray, symbols: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the sequence with its frequent pairs replaced, and their rules."""
    kind = np.uint32 if symbols <= 1 << 16 else np.uint64  # what the pairs' numbers fit in
    codes = seq[:-1].astype(kind) * kind(symbols) + seq[1:].astype(kind)
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    frequent = np.flatnonzero(counts >= least)
    if not len(frequent):
        return seq, np.empty((0, 2), np.uint32)
    if len(frequent) > most:
        frequent = np.sort(frequent[np.argsort(-counts[frequent], kind="stable")[:most]])
    pairs = ordered[starts[frequent]]
    # a table of the pairs by hash; a pair that loses its place to another one waits a round
    bits = max(10, int(len(pairs) * 4).bit_length())
    width = kind().itemsize * 8
    spread = kind(0x9E3779B1 if width == 32 else 0x9E3779B97F4A7C15)
    slot = lambda c: (c * spread) >> kind(width - bits)
    owner = np.full(1 << bits, -1, np.int32)
    owner[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    candidate = owner[slot(codes)]
    at = np.flatnonzero((candidate >= 0) & (pairs[candidate] == codes))
    if not len(at):
        return seq, np.empty((0, 2), np.uint32)
    # neighbouring places overlap: every second one of a run is taken
    new_run = np.concatenate([[True], np.diff(at) != 1])
    first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
    at = at[(np.arange(len(at)) - first) % 2 == 0]
    taken = candidate[at]
    used = np.flatnonzero(np.bincount(taken))
    rule = np.zeros(len(pairs), np.uint32)
    rule[used] = np.arange(symbols, symbols + len(used))
    out = seq.copy()
    out[at] = rule[taken]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    chosen = pairs[used]
    return out[keep], np.stack([chosen // kind(symbols), chosen % kind(symbols)], 1).astype(np.uint32)


def compress(ids: np.ndarray, rounds: int = 8, least: int = 8, most: int = 8192):
    """(alphabet, rules, sequence): Re-Pair in rounds of many pairs."""
    alphabet = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if len(ids) else np.empty(0, np.uint32)
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    seq, rules = number[ids], []
    for _ in range(rounds):
        if len(seq) < 2:
            break
        before = len(seq)
        seq, new = _replace(seq, len(alphabet) + sum(map(len, rules)), least, most)
        if not len(new):
            break
        rules.append(new)
        if before - len(seq) < before // 100:
            break
    return alphabet, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), seq


def lengths_of(n_terminals: int, rules: np.ndarray) -> np.ndarray:
    """The expanded length of every symbol."""
    out = np.ones(n_terminals + len(rules), np.int64)
    done = n_terminals
    while done < len(out):  # rules whose parts are all known, a round's at a time
        ready = (rules[done - n_terminals :] < done).all(1)
        end = done + (len(ready) if ready.all() else int(ready.argmin()))
        part = rules[done - n_terminals : end - n_terminals]
        out[done:end] = out[part[:, 0]] + out[part[:, 1]]
        done = end
    return out


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, **how) -> tuple[bytes, int]:
    """A shard's bytes, and the number of symbols left."""
    alphabet, rules, seq = compress(ids, **how)
    lengths = lengths_of(len(alphabet), rules)
    ends = np.cumsum(lengths[seq])
    index = np.concatenate([[0], ends])[:-1][::STEP] if len(seq) else np.empty(0)
    width = "<u2" if len(lengths) <= 1 << 16 else "<u4"
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(counts, "<i8"),
        alphabet.astype("<u4"), rules.astype("<u4"), lengths[len(alphabet) :].astype("<i8"), index.astype("<i8"), seq.astype(width)]
    head = _HEAD.pack(MAGIC, len(doc_ids), len(alphabet), len(rules), len(seq), len(ids), int(width[-1]))
    return head + b"".join(p.tobytes() for p in parts), len(seq)


class Shard:
    """A shard read back."""

    def __init__(self, blob: bytes):
        magic, docs, terminals, rules, symbols, self.n_ids, width = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.counts = take(docs, "<i8")
        self.alphabet, self.rules = take(terminals, "<u4"), take(2 * rules, "<u4").reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(terminals, np.int64), take(rules, "<i8")])
        self.table = None
        self.index, self.seq = take(-(-symbols // STEP), "<i8"), take(symbols, f"<u{width}")

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols, each copied from the symbols' written-out expansions."""
        if self.table is None:
            n = len(self.alphabet)
            self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
            self.table = np.empty(int(self.lengths.sum()), np.uint32)
            self.table[:n] = self.alphabet
            while n < len(self.lengths):  # rules whose parts are written, a round's at a time
                ready = (self.rules[n - len(self.alphabet) :] < n).all(1)
                end = n + (len(ready) if ready.all() else int(ready.argmin()))
                parts = self.rules[n - len(self.alphabet) : end - len(self.alphabet)].ravel()
                written = self._copied(parts)
                self.table[self.begins[n] : self.begins[n] + len(written)] = written
                n = end
        return self._copied(seq)

    def _copied(self, seq: np.ndarray) -> np.ndarray:
        lengths = self.lengths[seq]
        ends = np.cumsum(lengths)
        return self.table[np.repeat(self.begins[seq] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def span(self, start: int, length: int) -> np.ndarray:
        """The ids from ``start`` on, decoding only the symbols that cover them."""
        length = max(0, min(length, self.n_ids - start))
        if not length:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(self.index, start, "right")) - 1
        last = int(np.searchsorted(self.index, start + length, "left"))
        run = self.seq[first * STEP : last * STEP]
        ends = int(self.index[first]) + np.cumsum(self.lengths[run])
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + length, "left"))
        base = int(ends[lo] - self.lengths[run[lo]])
        return self.expand(run[lo : hi + 1])[start - base : start - base + length]


SHARDS = "part int, shard int, part_start long, n_ids long, n_symbols long, n_docs long, blob binary"
_SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def shards_of(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards in order of (part, shard); part_start counts the ids of the part before."""
    ordered = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, CACHED_PIECES)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        part, shard, before, size = TaskContext.get().partitionId(), 0, 0, 0
        names, counts, held = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, before
            ids = np.frombuffer(b"".join(held), f"<u{enc.width}")
            blob, symbols = pack_shard(names, counts, ids)
            row = (part, shard, before, len(ids), symbols, len(names), blob)
            shard, before = shard + 1, before + len(ids)
            for x in (names, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD_TYPES)], names=["part", "shard", "part_start", "n_ids", "n_symbols", "n_docs", "blob"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(doc_id)
                held.append(enc.encode(text) + end)
                counts.append(len(held[-1]) // enc.width)
                size += counts[-1]
                if size >= shard_ids:
                    yield close()
                    size = 0
        if names:
            yield close()

    return map_batches(ordered, run, SHARDS)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    shards_of(docs, tokenizer, end_id).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``: the number of ids before each in the whole table."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))  # one short row per part
    before = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(parts.select("part", F.coalesce(before, F.lit(0)).alias("offset")), "shard-offsets")
    return shards.join(offsets, "part").withColumn("start", F.col("offset") + F.col("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards alone: place, size and checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(blob)
                ids, ends = s.ids().astype("<u4"), np.cumsum(s.counts)
                begins = ends - s.counts
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(begins + start), pa.array(s.counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(read_shards(spark, path).select("start", "blob"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' shards to the shared folder, and read the documents back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
