"""Phrase collocations from FM-indexes over word ids.

Each shard (some documents of one language, cut at document ends) becomes a bidirectional
index: its words as ids, with 0 between pieces, and the Burrows-Wheeler transforms of that
sequence and of its reverse, sorted as deep as phrases reach. The index is a table, so a
lost executor rebuilds its own shards only. A pattern is a pair of intervals, one in each
transform; extending it to the right reads the symbols of its interval in the reverse
transform, extending it to the left those in the forward one, and the counts of smaller
symbols move the other interval along. All intervals of a length are extended at once.
Counts of shards are summed by Spark.

A longer phrase is frequent only where each pair of words in it is. So pairs are counted
first, as 64-bit hashes; a filter of 2**26 bits (8 MB at any input size) holds those that
reach the limit, and only extensions whose pairs pass it are counted as texts. A hash that
collides lets a rare pair through, to be counted exactly; none is lost. When a corpus fills
the filter, more is shuffled and the result stays the same.

Defined results: a null text is empty, a null lang is ``und``; texts without words add
nothing; documents that repeat count each time; a piece longer than a shard stays whole in
one; an empty table gives no rows; ties go by the stated order, in which phrases differ;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidebar.llm.base import LOWER, UPPER, batch, map_batches
from tidebar.session import staged

SHARD_BYTES = 6_000_000
FILTER_BITS = 26
BREAK = b"\n"

# A-Z fold to a-z, tabs are blanks, and these characters end a piece.
_FOLD = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\x0b\x0c\r", LOWER.encode() + b" " + BREAK * 9)


@dataclass
class Intervals:
    """Patterns of one length: their words (one row each), and where they lie."""

    words: np.ndarray
    forward: np.ndarray
    reverse: np.ndarray
    size: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Intervals:
        return Intervals(self.words[which], self.forward[which], self.reverse[which], self.size[which])


def _transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """The symbols before each suffix of the circular sequence, suffixes sorted by ``depth`` symbols."""
    order = np.arange(len(ids), dtype=np.int32)
    for d in range(depth - 1, -1, -1):
        order = order[np.argsort(np.roll(ids, -d)[order], kind="stable")]
    return ids[order - 1]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts in place."""
    key.sort()
    start = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return key[start], np.diff(start, append=len(key))


class BidirectionalIndex:
    def __init__(self, words: list[bytes], before: np.ndarray, after: np.ndarray):
        """``before`` and ``after``: the transforms of the sequence and of its reverse."""
        self.words, self.before, self.after = words, before, after
        self.counts = np.bincount(before, minlength=len(words) + 1)
        self._ranks: dict[bool, np.ndarray] = {}

    @classmethod
    def of(cls, texts: list[bytes], depth: int) -> BidirectionalIndex:
        raw = BREAK.join([b"", *texts, b""]).translate(_FOLD).replace(BREAK, b" \n ")
        tokens = pc.split_pattern(pa.array([raw], pa.large_binary()), b" ").flatten()
        coded = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = words.index(BREAK)
        number = np.arange(1, len(words) + 1, dtype=np.int32)
        number[at + 1 :] -= 1
        number[at] = 0
        del words[at]
        ids = number[coded.indices.to_numpy()]
        ids = ids[(ids > 0) | (np.roll(ids, 1) > 0) | (np.arange(len(ids)) == 0)]
        return cls(words, _transform(ids, depth), _transform(ids[::-1], depth))

    def single(self) -> Intervals:
        """Patterns of one word."""
        start = np.cumsum(self.counts) - self.counts
        return Intervals(np.arange(1, len(self.counts))[:, None], start[1:], start[1:], self.counts[1:])

    def extend(self, of: Intervals, left: bool, more: bool = False,
               wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Intervals:
        """Every pattern with each word that stands before it (``left``) or after it.

        ``more``: the result is to be extended on the same side again. ``wanted`` tells, by
        the old pattern and the new word, which extensions are worth counting.
        """
        symbols, start, other = (self.before, of.forward, of.reverse) if left else (self.after, of.reverse, of.forward)
        n = len(self.counts)
        first = np.cumsum(of.size) - of.size
        key = np.arange(int(of.size.sum()))
        key += np.repeat(start - first, of.size)
        key = symbols[key] + np.repeat(np.arange(len(start)) * n, of.size)
        key, size = _counted(key)
        owner, symbol = key // n, key % n
        smaller = np.cumsum(size) - size
        moved = other[owner] + smaller - first[owner]
        keep = symbol > 0
        if wanted is not None:
            keep[keep] = wanted(owner[keep], symbol[keep])
        owner, symbol, size, moved = owner[keep], symbol[keep], size[keep], moved[keep]
        own = self._ranked(left, symbol, start[owner]) if more else np.full(len(owner), -1)
        new = [symbol[:, None], of.words[owner]]
        return Intervals(np.concatenate(new if left else new[::-1], axis=1), *((own, moved) if left else (moved, own)), size)

    def _ranked(self, left: bool, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's suffixes begin, plus its occurrences before a row."""
        symbols = self.before if left else self.after
        if left not in self._ranks:
            self._ranks[left] = np.sort(symbols.astype(np.int64) * len(symbols) + np.arange(len(symbols)))
        return np.searchsorted(self._ranks[left], symbol * len(symbols) + at)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in [b"", *self.words]), np.uint64, len(self.words) + 1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _packed(raw: bytes) -> bytes:
    """Length, then the bytes by zstd: a transform has many runs."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


INDEX = "lang string, words binary, before binary, after binary"
_INDEX_TYPES = [pa.string(), pa.binary(), pa.binary(), pa.binary()]


def index_shards(docs: DataFrame, longest: int = 3, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its language and its index."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text")).where("length(text) > 0")

    def shard(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        x = BidirectionalIndex.of(texts, longest - 1)
        values = [[lang], *([_packed(v)] for v in (BREAK.join(x.words), x.before.tobytes(), x.after.tobytes()))]
        pa.default_memory_pool().release_unused()
        return batch(["lang", "words", "before", "after"], values, _INDEX_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                while size and (max(size.values()) >= shard_bytes or sum(size.values()) >= 2 * shard_bytes):
                    full = max(size, key=size.get)
                    del size[full]
                    yield shard(full, held.pop(full))
        for lang, texts in held.items():
            yield shard(lang, texts)

    return map_batches(rows, run, INDEX)


def _opened(row: dict) -> BidirectionalIndex:
    words = _unpacked(row["words"])
    transforms = (np.frombuffer(_unpacked(row[c]), np.int32) for c in ("before", "after"))
    return BidirectionalIndex(words.split(BREAK) if words else [], *transforms)


def _pair_counts(index: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = _opened(row)
                h, pairs = x.hashes() ^ np.uint64(xxhash.xxh64_intdigest(row["lang"])), x.extend(x.single(), left=False)
                of = pair_hash(h[pairs.words[:, 0]], h[pairs.words[:, 1]]).view(np.int64)
                for i in range(0, len(of), 200_000):
                    yield batch(["pair", "n"], [of[i : i + 200_000], pairs.size[i : i + 200_000]], [pa.int64()] * 2)

    # a shard's pairs are distinct, so there is nothing to combine before the shuffle
    return map_batches(index, run, "pair long, n long").repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_pairs(index: DataFrame, least: int) -> np.ndarray:
    """A filter of 2**26 bits, as 64-bit words, with the hashes of pairs that occur ``least`` times."""
    bit = F.shiftrightunsigned(F.col("pair"), 64 - FILTER_BITS)
    words = (_pair_counts(index).where(F.col("n") >= least).select(bit.alias("bit"))
             .groupBy(F.shiftrightunsigned("bit", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def count_phrases(index: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, size, phrase, n: words and phrases that occur ``least`` times; size 0 and no
    phrase for all words of a language."""
    shared = index.sparkSession.sparkContext.broadcast(frequent_pairs(index, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for row in b.to_pylist():
                x = _opened(row)
                h = x.hashes() ^ np.uint64(xxhash.xxh64_intdigest(row["lang"]))
                text = pa.array(x.words, pa.binary()).cast(pa.string())

                def frequent(a: np.ndarray, c: np.ndarray) -> np.ndarray:
                    at = pair_hash(h[a], h[c]) >> np.uint64(64 - FILTER_BITS)
                    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

                now = x.single()
                yield batch(["lang", "size", "phrase", "n"], [[row["lang"]], [0], [""], [int(now.size.sum())]],
                            [pa.string(), pa.int32(), pa.string(), pa.int64()])
                for size in range(1, longest + 1):
                    if size == 2:
                        old = now
                        now = x.extend(old, left=False, wanted=lambda i, w: frequent(old.words[i, -1], w))
                    elif size > 2:
                        old = now
                        now = x.extend(old, left=True, more=size < longest, wanted=lambda i, w: frequent(w, old.words[i, 0]))
                    for i in range(0, len(now.size), 100_000):
                        part = now.words[i : i + 100_000] - 1
                        phrase = text.take(pa.array(part[:, 0]))
                        if size > 1:
                            phrase = pc.binary_join_element_wise(phrase, *(text.take(pa.array(w)) for w in part[:, 1:].T), " ")
                        k = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["lang"]] * k), pa.array(np.full(k, size, np.int32)), phrase,
                             pa.array(now.size[i : i + 100_000])], names=["lang", "size", "phrase", "n"])

    by = ["lang", "size", "phrase"]
    return map_batches(index, run, "lang string, size int, phrase string, n long") \
        .groupBy(*by).agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times.

    score: floor(1e6 a a / (l r)) at the cut where it is lowest. A phrase inside a longer one
    with at least ``share`` percent of its count is left out.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    counts = staged(count_phrases(staged(index_shards(docs, longest), "phrase-index"), least, longest), "phrases")
    total = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    frequent = counts.where("size > 0")
    longer = frequent.where("size > 2").select(
        "lang", F.col("n").alias("outer"), F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), "
            "i -> array_join(slice(split(phrase, ' '), i, k), ' '))))")).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    found = frequent.where("size > 1").join(covered, ["lang", "phrase"], "left") \
        .where(F.coalesce(100 * F.col("outer") < share * F.col("n"), F.lit(True))) \
        .select("lang", "phrase", F.col("n").alias("a"), "size")
    cuts = found.select("lang", "phrase", "a", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k")) \
        .withColumn("first", F.expr("array_join(slice(split(phrase, ' '), 1, k), ' ')")) \
        .withColumn("rest", F.expr("array_join(slice(split(phrase, ' '), k + 1, size - k), ' ')"))
    parts = frequent.where(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), "n")
    scored = (cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
              .join(parts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
              # decimals: the products may pass 64 bits; the quotient is at most 1e6
              .withColumn("score", F.expr("(1000000BD * cast(a as decimal(15)) * cast(a as decimal(15))) "
                                          "div (cast(l as decimal(18)) * cast(r as decimal(18)))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # the best of slices first, so that no task sorts a whole language
    order = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = (scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order)))
            .where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("rank") <= top))
    return best.join(F.broadcast(total) if _few(total) else total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))


def _few(total: DataFrame, rows: int = 100_000) -> bool:
    return total.limit(rows + 1).count() <= rows
