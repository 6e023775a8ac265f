"""The prefix trie of conversations by truncation peeling.

Nodes are distinct sequences of first turns. Peeling begins at the deepest level that two
different conversations share. At each level the conversations that end there meet the nodes
that survive from below, everything with one prefix becomes one node, and its last turn is
stripped, which gives the prefix of the next level up. A node's figures (members, children,
leaves, what sharing saves) are sums over what met in it, so each level is one aggregation
that combines before its shuffle: a first turn that a third of all conversations share is one
row per task. Equal conversations are one row with a count before peeling begins, and the tail
that a conversation shares with no different one is written down as it is; the number of
levels is that of shared turns, whatever the longest conversation.

A prefix is known by the sum of the 128-bit digests of its (place, role, text): stripping a
turn is subtracting its digest. Sums also let turns be numbered and added up in parts, so
that a very long conversation is spread over tasks. Only the ids that end at one node go
through one task, as a stream of joined pieces of 4,096, since SHA-256 reads them in order.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then
role and text, so ties and repeated rows (which stay turns of their own) have one order; rows
with a null conv_id belong to no conversation and are left out; an empty table has no root;
other columns are not read. Turns of one conversation with one turn number go to one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.base import batch, map_batches
from tidebar.session import staged

BLOCK = 1024
PIECE = 4096
LIMBS = ("s1", "s2", "s3", "s4")
KEY = ("k1", "k2")
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def number_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest of role and text, bytes of the text."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, place = TaskContext.get().partitionId(), None, 0
        for b in batches:
            out = ([], [], [], [], [])
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                now, place = conv, place + 1 if conv == now else 0
                role, text = role.encode("utf-8", "replace"), text.encode("utf-8", "replace")
                digest = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
                for c, v in zip(out, (conv, part, place, digest, len(text))):
                    c.append(v)
            yield batch(["conv_id", "part", "place", "digest", "n_bytes"], list(out),
                        [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()])

    found = staged(map_batches(rows, run, "conv_id long, part int, place long, digest binary, n_bytes long"), "turns")
    # a conversation that began in an earlier part: at most one per part, so a bounded table
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (found.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(earlier)).where("before > 0").drop("n"))
    return found.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "n_bytes")


def rebuild(numbered: DataFrame, group: int = 5, reach: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations). Conversation c is the first h turns of c - c % group, then its
    own after its first h, with h = crc32(c) % reach."""
    own = staged(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % reach).alias("h")
    convs = own.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base")) \
        .join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left") \
        .withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))) \
        .withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n", "n_base")
    convs = staged(convs, "rebuilt")
    rest = numbered.join(convs.drop("base"), "conv_id").where("place >= h") \
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "n_bytes", "size")
    first = numbered.where(F.col("place") < reach).withColumnRenamed("conv_id", "base").join(convs, "base") \
        .where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_bytes", "size")
    return rest.unionByName(first), convs.select("conv_id", "size")


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def _key(limbs: list[Column], names: tuple[str, str]) -> list[Column]:
    a, b, c, d = (_low(x) for x in limbs)
    return [F.shiftleft(a, 32).bitwiseOR(b).alias(names[0]), F.shiftleft(c, 32).bitwiseOR(d).alias(names[1])]


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that it ends, that of the prefix before it, and
    the bytes up to it. Running sums go by blocks of turns, then over blocks."""
    h1, h2 = F.xxhash64("digest", "depth"), F.xxhash64("depth", "digest")
    own = dict(zip(LIMBS, (_low(h1), F.shiftrightunsigned(h1, 32), _low(h2), F.shiftrightunsigned(h2, 32)))) | {"b": F.col("n_bytes")}
    rows = turns.withColumns({f"own_{k}": v for k, v in own.items()}).withColumn("block", F.expr(f"depth div {BLOCK}"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy("conv_id", "block").agg(*[F.sum(f"own_{k}").alias(k) for k in own])
              .select("conv_id", "block", *[F.sum(k).over(earlier).alias(f"to_{k}") for k in own]).where("block > 0"))
    sums = {k: F.sum(f"own_{k}").over(inside) for k in own}
    rows = rows.withColumns({f"in_{k}": v for k, v in sums.items()}).join(blocks, ["conv_id", "block"], "left")
    total = {k: F.col(f"in_{k}") + F.coalesce(f"to_{k}", F.lit(0)) for k in own}
    return rows.select(
        "conv_id", "depth", "size", "n_bytes", total["b"].alias("bytes_to"), *_key([total[k] for k in LIMBS], KEY),
        *_key([total[k] - F.col(f"own_{k}") for k in LIMBS], ("p1", "p2")))


def _digests(ends: DataFrame) -> DataFrame:
    """Per (size, k1, k2): SHA-256 of its ids in ascending order, joined by commas."""
    by = ["size", *KEY]
    pieces = ends.groupBy(*by, (F.col("conv_id") - F.pmod("conv_id", F.lit(PIECE))).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    pieces = pieces.repartition(*by).sortWithinPartitions(*by, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return batch([*by, "ends"], [list(c) for c in zip(*rows)] if rows else [[]] * 4, [*[pa.int64()] * 3, pa.string()])

        for b in batches:
            rows = []
            for *key, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if now is not None:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield done(rows)
        if now is not None:
            yield done([(*now, digest.hexdigest())])

    return map_batches(pieces, run, "size long, k1 long, k2 long, ends string")


def peel(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes. ``turns``: conv_id, depth (from 1), digest, n_bytes, size; ``convs``: conv_id, size."""
    spark = turns.sparkSession
    by = ["size", *KEY]
    rows = staged(prefixes(turns), "prefixes")
    ends = rows.where("depth = size").select("conv_id", *by, "bytes_to").unionByName(
        convs.where("size = 0").select("conv_id", "size", *[F.lit(0).cast("long").alias(c) for c in (*KEY, "bytes_to")]))
    ends = staged(ends, "ends")
    same = staged(ends.groupBy(*by).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"),
                                        F.max("bytes_to").alias("bytes")).join(_digests(ends), by), "distinct")

    # one row per distinct conversation and turn, and from which turn on nothing different shares it
    kept = rows.join(same.select("conv_id", "copies", "bytes", "ends"), "conv_id")
    alone = rows.join(same.select("conv_id"), "conv_id", "left_semi").groupBy("depth", *KEY) \
        .agg(F.min("conv_id").alias("conv_id"), F.max("conv_id").alias("other")).where("conv_id = other") \
        .groupBy("conv_id").agg(F.min("depth").alias("alone"))
    kept = staged(kept.join(alone, "conv_id", "left").withColumn("alone", F.coalesce("alone", F.col("size") + 1)), "kept")

    tail = kept.where("depth >= alone")
    saved = ((F.col("copies") - 1) * (F.col("bytes") - F.col("bytes_to") + F.col("n_bytes"))).alias("saved")
    last = F.col("depth") == F.col("size")
    tails = tail.select("depth", *KEY, "p1", "p2", "conv_id", F.col("copies").alias("n"),
                        F.when(last, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
                        saved, F.when(last, F.col("ends")).alias("ends"), (F.col("depth") > F.col("alone")).alias("inner"))

    zero, none = F.lit(0).cast("long"), F.lit(None)
    ending = kept.where("depth < alone").select(
        F.col("depth").alias("level"), *KEY, "p1", "p2", "n_bytes", F.when(last, F.col("conv_id")).alias("conv_id"),
        F.when(last, F.col("copies")).otherwise(0).cast("long").alias("n"), zero.alias("children"), zero.alias("leaves"),
        zero.alias("saved"), F.when(last, F.col("ends")).alias("ends"))
    root = same.where("size = 0").select(
        zero.alias("level"), *KEY, zero.alias("p1"), zero.alias("p2"), zero.alias("n_bytes"), "conv_id",
        F.col("copies").alias("n"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    stripped = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), *[none.cast("long").alias(c) for c in ("p1", "p2", "n_bytes")],
                "conv_id", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", none.cast("string").alias("ends")]
    entering = tails.where("not inner").select((F.col("depth") - 1).alias("level"), *stripped)
    arrivals = staged(ending.unionByName(root).unionByName(entering), "arrivals", ("level",))

    deepest = arrivals.agg(F.max("level")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], NODE)
    levels, below = [], None
    for level in range(deepest, -1, -1):
        met = arrivals.where(F.col("level") == level).drop("level")
        if below is not None:
            met = met.unionByName(below.select(*stripped))
        nodes = met.groupBy(*KEY).agg(
            F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.coalesce(F.max("n_bytes"), zero).alias("n_bytes"),
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.max("ends").alias("ends"))
        below = staged(nodes.withColumns({
            "leaves": F.greatest("leaves", F.lit(1)), "saved": F.col("saved") + (F.col("n") - 1) * F.col("n_bytes")}), "level")
        levels.append(below.drop("n_bytes").withColumn("depth", F.lit(level).cast("long")))

    shared = reduce(DataFrame.unionByName, levels)
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                            F.col("conv_id").alias("parent_conv_id"))
    linked = shared.unionByName(tails.where("not inner").drop("inner")).join(parents, ["depth", "p1", "p2"], "left")
    inner = tails.where("inner").drop("inner").withColumn("parent_conv_id", F.col("conv_id"))
    return linked.unionByName(inner).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return peel(*rebuild(number_turns(turns)))
