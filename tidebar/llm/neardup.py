"""Near duplicates by SetSketch registers, banding, joint likelihood and exact verification.

1. A document's sketch has 252 registers: register i is ``floor(1 - log_b(x_i / a))`` of the
   smallest of the exponentially distributed hashes that its shingles get there, truncated to
   16 bits. The sketch of a union is the register-wise maximum.
2. Documents with one shingle set are one class and go on as one row.
3. Bands of registers (42 of 6 at 80 percent) make buckets; each member of a bucket is a candidate with the
   bucket's smallest class only, so a bucket of n rows gives n pairs, never n * n.
4. A pair's similarity is estimated by maximum likelihood over its registers' order
   (larger, smaller, equal, given both set sizes). Pairs that could reach the threshold
   within five standard errors are verified on the full sets.
5. A bucket whose members are then in more than one component may hide further links. All
   members of such buckets get a prefix: shingles ordered by how rare they are there. Prefix
   rows that no set of another component could be met at drop out by the exact join's own
   bound. A member that shares a prefix shingle with another component is verified against
   that component's member with the fewest rarer shingles, as long as a quarter of these pairs
   are links. Members still apart are joined exactly: prefix, length, position and bitmap
   filters, only pairs across components, step 4.

Two documents at the threshold share no band with a probability below 1e-5. Python runs in
Arrow batches and holds one text (or pair) and a bounded cache of word hashes, which a task
gives back at its end.

Defined results: a text without words has an empty set, is linked with nothing and is kept;
with fewer words than a shingle takes, the whole sequence is the one shingle. A null doc_id
can't name a component: its members with ids do, and a component without any id has a null
component_id; a null doc_id is never ``kept``; texts that occur under no id at all are linked with nothing.
Repeated rows get equal rows. An empty table
gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.base import map_batches, texts
from tidebar.llm.components import components
from tidebar.session import staged

REGISTERS = 252
MISSED = 1e-5  # the largest probability that a pair at the threshold shares no band
BASE, RATE = 1.001, 20.0
CACHED_WORDS = 400_000
COUNTERS = 1 << 18  # hashed counts that order shingles by rarity: a bounded array
BITS = 2048  # places of a member's bitmap; sets of many more shingles pass its filter more often, never less
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to its 64-bit hash as bytes; emptied when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return value


_WORDS = _Words()


def forget_words() -> None:
    """At the end of a task: what a worker keeps between tasks adds up over an executor."""
    _WORDS.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), "<u8")
    size = min(k, len(words))
    out = h[: len(h) - size + 1].copy()
    for j in range(1, size):
        out = _mixed(out) + h[j : len(h) - size + 1 + j]
    return np.unique(_mixed(out + np.uint64(size)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: truncated logarithms of the register-wise smallest exponentials."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential / RATE) / np.log(BASE)), 0, 65535).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs (rows of registers) with known set sizes."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):  # the probability that one register is larger by what only one set has
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    log = lambda q: np.log(np.clip(q, 1e-12, 1))
    fit = larger[:, None] * log(more) + smaller[:, None] * log(less) + equal[:, None] * log(1 - more - less)
    return j[np.arange(len(j)), fit.argmax(1)] if len(j) else np.empty(0)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, set_key (null for an empty set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, regs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, shingle)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "n", "set_key", "sketch"])
        forget_words()

    return map_batches(texts(docs), run, "doc_id long, n long, set_key binary, sketch binary")


def rows_of_band(percent: int) -> int:
    """The most registers a band may have for the threshold: 6 at 80 %, in 42 bands."""
    fits = [r for r in (6, 4, 3, 2) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED]
    return fits[0] if fits else 1


def band_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(bucket, node): one row per class and band."""
    rows = rows_of_band(percent)
    band = f"substring(sketch, i * {2 * rows} + 1, {2 * rows})"
    return classes.select(F.expr(f"explode(transform(sequence(0, {REGISTERS // rows - 1}), i -> xxhash64(i, {band})))").alias("bucket"), "node")


def similar_enough(n_a: Column, n_b: Column, percent: int) -> Column:
    """The length filter: smaller sets can't reach the threshold."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def verified(pairs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet the threshold."""
    side = lambda x: members.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "set_key", "sketch", "text")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(similar_enough(F.col("n_a"), F.col("n_b"), percent))
    both = both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "set_key_a", "set_key_b", "text_a", "text_b")
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}

        def set_of(end: str, node: int, key: bytes, text: str) -> np.ndarray | None:
            if last.get(end, (None,))[0] != node:
                s = shingle_set(text, shingle)
                last[end] = (node, s if xxhash.xxh3_128_digest(s.tobytes()) == key else None)
            return last[end][1]

        for b in batches:
            if not b.num_rows:
                continue
            c = {name: b.column(name).to_pylist() for name in b.schema.names}
            regs = [np.frombuffer(b"".join(c[s]), "<u2").reshape(-1, REGISTERS) for s in ("sketch_a", "sketch_b")]
            likely = likely_similarity(*regs, np.array(c["n_a"], float), np.array(c["n_b"], float)) >= least
            found = []
            for i in np.flatnonzero(likely):
                s = set_of("a", c["a"][i], c["set_key_a"][i], c["text_a"][i])
                t = set_of("b", c["b"][i], c["set_key_b"][i], c["text_b"][i])
                if s is None or t is None:  # another text under the same doc_id
                    continue
                shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    found.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c["a"][i] for i in found], pa.int64()), pa.array([c["b"][i] for i in found], pa.int64())], names=["a", "b"])
        forget_words()

    return map_batches(both, run, "a long, b long").distinct()


def _rarity(members: DataFrame, shingle: int) -> np.ndarray:
    """Counts of all the members' shingles in a fixed number of hashed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                total += np.bincount((shingle_set(text, shingle) % COUNTERS).astype(np.int64), minlength=COUNTERS)
        forget_words()
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["k", "c"])

    rows = map_batches(members.select("text"), run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    out = np.zeros(COUNTERS, np.int64)
    found = rows.toArrow()  # at most COUNTERS rows
    out[found.column("k").to_numpy()] = found.column("c").to_numpy()
    return out


def prefix_rows(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(s, at, node, n): the shingles of each member's prefix, rarest first, with their places."""
    counts = _rarity(members, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for node, n, text in zip(*cols):
                s = shingle_set(text, shingle)
                first = np.lexsort((s, counts[(s % COUNTERS).astype(np.int64)]))[: len(s) - -(-percent * len(s) // 100) + 1]
                for column, values in zip(out, (s[first].view(np.int64), np.arange(len(first)), *[np.full(len(first), v) for v in (node, n)])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=["s", "at", "node", "n"])
        forget_words()

    return map_batches(members.select("node", "n", "text"), run, "s long, at long, node long, n long")


def bitmaps(members: DataFrame, shingle: int) -> DataFrame:
    """(node, bits): which of BITS hashed places a member's shingles take, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                taken = np.zeros(BITS, np.uint8)
                taken[((shingle_set(text, shingle) >> np.uint64(20)) % BITS).astype(np.int64)] = 1
                out.append(np.packbits(taken).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "bits"])
        forget_words()

    return map_batches(members.select("node", "text"), run, "node long, bits array<long>")


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """The shingles that sets of these sizes have to share."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / (100 + percent))


def reachable(rows: DataFrame, percent: int) -> DataFrame:
    """The rows at which a member could meet another component: the shingle lies in more than
    one, and what follows it in the member is enough for the smallest set that the length
    filter and the shingle's members leave. No pair of the exact join is lost."""
    each = rows.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
    met = rows.join(each.where("low != high").select("s", "least"), "s")
    smallest = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))
    return met.where(F.col("n") - F.col("at") >= needed(F.col("n"), smallest, percent)).drop("least")


def mixed_shingles(rows: DataFrame) -> DataFrame:
    """(s, main, hub): prefix shingles that lie in more than one component, the component that
    most of their members are in, and its member with the fewest rarer shingles."""
    each = rows.groupBy("s", "label").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("at", "node")).alias("first"))
    return each.groupBy("s").agg(F.max(F.struct("members", "label", "first")).alias("most"), F.count(F.lit(1)).alias("labels")) \
        .where("labels > 1").select("s", F.col("most.label").alias("main"), F.col("most.first.node").alias("hub"))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a member and the hub of a shingle of its prefix: at most one pair per row. Near
    copies of one text are like that text rather than like each other, and it has no rare
    shingles of its own, so this joins most of them at once."""
    met = rows.join(staged(mixed_shingles(rows), "mixed-shingles"), "s").where("label != main")
    return met.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members with different labels that pass the prefix, length, position and
    bitmap filters of an exact join at the threshold; ``rows`` as from reachable, ``bits`` as
    from bitmaps. A place that only one of two sets takes is a shingle that they don't share."""
    side = lambda df, x: df.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("at", "node", "n", "label", "bits")])
    rows = staged(rows.join(bits, "node"), "mapped-rows")
    # members outside a shingle's main component meet all its others
    minor = rows.join(staged(mixed_shingles(rows), "shared-shingles"), "s").where("label != main")
    need = needed(F.col("n_a"), F.col("n_b"), percent)
    left = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    alone = lambda x, y: F.expr(" + ".join(f"bit_count(bits_{x}[{i}] & ~bits_{y}[{i}])" for i in range(BITS // 64)))
    met = side(rows, "a").join(staged(side(minor, "b"), "minor"), "s").where(
        (F.col("label_a") != F.col("label_b")) & similar_enough(F.col("n_a"), F.col("n_b"), percent) & (left >= need)
        & (F.col("n_a") - alone("a", "b") >= need) & (F.col("n_b") - alone("b", "a") >= need))
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = texts(docs)
    sketched = staged(sketches(docs, shingle), "sketches")
    classes = sketched.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once written
    rows = band_rows(classes, percent)
    buckets = staged(rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets")
    crowded = staged(rows.join(buckets.select("bucket", "first"), "bucket"), "bucket-members")
    star = staged(crowded.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "star-pairs")
    inside = classes.join(crowded.select("node").distinct(), "node", "left_semi")
    members = staged(inside.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("node", "n", "set_key", "sketch", "text"), "members")
    links = staged(verified(star, members, shingle, percent), "star-links")
    labels = components(links)
    labelled = crowded.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    open_nodes = staged(labelled.join(staged(mixed, "mixed"), "bucket", "left_semi").select("node", "label").distinct(), "open-nodes")
    prefixes = staged(prefix_rows(members.join(open_nodes.select("node"), "node", "left_semi"), shingle, percent), "prefixes")
    with_labels = lambda: staged(reachable(
        prefixes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), percent), "labelled")
    rows, tried = with_labels(), 1
    while tried:  # join what is near a shingle's hub; what is left of a group after that is small
        hub = staged(hub_pairs(rows), "hub-pairs")
        near = staged(verified(hub, members, shingle, percent), "hub-links")
        tried, found = hub.count(), near.count()
        if found:
            links = staged(links.unionByName(near), "links")
            labels = components(links)
            rows = with_labels()
        if 4 * found < tried:
            break
    bits = staged(bitmaps(members.join(rows.select("node").distinct(), "node", "left_semi"), shingle), "bitmaps")
    pairs = staged(prefix_pairs(rows, bits, percent), "prefix-pairs")
    more = staged(verified(pairs, members, shingle, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = staged(classes.select("set_key", "rep", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    names = staged(named.groupBy("label").agg(F.min("rep").alias("component_id")), "names")  # written, so that a large component is split
    final = staged(named.join(names, "label").select("set_key", "component_id"), "class-components")
    out = sketched.select("doc_id", "n", "set_key").join(final, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all columns; rows without doc_id stay, and rows
    that repeat an id with the same text count as one document."""
    judged = near_duplicates(docs, shingle, percent).where("doc_id is not null")
    ids = staged(judged.groupBy(F.col("doc_id").alias("id")).agg(F.count_if("kept").alias("rows")).where("rows != 1"), "changed-ids")
    gone, repeated = ids.where("rows = 0"), ids.where("rows > 1")  # the ids that stay as they are need no join
    same = lambda other: F.col("doc_id").cast("long") == other["id"]
    if repeated.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    once = docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(ids, same(ids), "left_anti").unionByName(once)
