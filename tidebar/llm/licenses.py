"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

Blocks are overlapping windows of the whole text's words, across its lines. A template of
at most 8, 16, 32, ... words meets windows of twice that many words, one at every such
number, so it lies whole in a window wherever it begins, and its words aren't
gathered from far apart. Templates of any length have blocks of their own size.
The tokens of all templates are ranked by how often
they occur in the whole corpus, rarest first; tokens outside the templates can't add to an
overlap and are left out. A template that shares at least ``need = ceil(t * size)`` tokens
with a block shares one among its ``size - need + 1`` rarest and the block's
``n - need + 1`` rarest (prefix filter); blocks with fewer than ``need`` tokens are passed
over (length filter), and so are meetings too late in either order to reach ``need``
(position filter). What is left is verified on whole sets, so no block is missed.

DataFrame functions only. What the driver holds is bounded by the templates (a parameter).
Matches are reduced to one row per document and template before they are shuffled.

Defined results: a null or empty text has no words, null first and last word, empty labels
and score 0; repeated rows get equal rows; an empty table gives no rows; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.base import lower_ascii, texts

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Labels and short notices of well-known licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST_STRIDE = 8


def words_of(text: str) -> list[str]:
    """The words of an already lower-cased text."""
    return [w for w in re.split(SEPARATORS, text) if w]


def stride_of(template: str) -> int:
    """Words from one of the template's blocks to the next; a block has twice as many."""
    stride = LEAST_STRIDE
    while stride < len(words_of(template.lower())):
        stride *= 2
    return stride


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def literal_array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in a word array of at least its length."""
    parts = phrase.split()
    inside = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), inside)


def base_columns(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, found (labels)."""
    low = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), lower_ascii(F.col("text")).alias("low"))
    some = "|".join(SEPARATORS.join(p.split()) for p, _ in phrases)
    low = low.select("doc_id", "text_hash", F.col("low").rlike(some).alias("some"), word_array(F.col("low")).alias("words"))
    none = F.array().cast("array<int>")
    for k, (p, _) in enumerate(phrases):
        enough = F.col("some") & (F.size("words") >= len(p.split()))
        low = low.withColumn(f"p{k}", F.when(enough, phrase_places(F.col("words"), p)).otherwise(none))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    found = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    return low.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        found.alias("found"))


def text_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Texts with a word of the vocabulary, as word arrays."""
    words = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), word_array(lower_ascii(F.col("text"))).alias("words"))
    return words.where(F.exists("words", lambda w: w.isin(*vocabulary)))


def blocks_of(words: DataFrame, strides: dict[int, list[str]]) -> DataFrame:
    """(doc_id, text_hash, stride, block) of the blocks with a word of their stride's list."""

    def of(stride: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.lit(stride + 1)), F.lit(stride))
        every = F.transform(starts, lambda i: F.slice("words", i + 1, 2 * stride))
        some = F.filter(every, lambda b: F.exists(b, lambda w: w.isin(*strides[stride])))
        return F.transform(some, lambda b: F.struct(F.lit(stride).alias("stride"), b.alias("block")))

    return words.select("doc_id", "text_hash", F.inline(F.concat(*map(of, sorted(strides)))))


def token_ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Every vocabulary word's place by corpus frequency over all texts, rarest first."""
    words = texts(docs).select(F.explode(F.filter(word_array(lower_ascii(F.col("text"))), lambda w: w.isin(*vocabulary))).alias("w"))
    count = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}  # bounded by the vocabulary
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


def block_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, label, containment, blocks) for each template label that some block
    contains to at least ``threshold`` of its distinct words."""
    sets = [(label, sorted(set(words_of(text.lower()))), stride_of(text)) for label, text in templates]
    sets = [x for x in sets if x[1]]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    ranks = token_ranks(docs, vocabulary)
    by_rank = sorted(ranks, key=ranks.get)
    index, members, strides, least = [], [], {}, {}
    for k, (label, s, stride) in enumerate(sets):
        order = sorted(ranks[w] for w in s)
        need = max(1, math.ceil(threshold * len(order) - 1e-9))
        members.append(order)
        index += [(order[i], k, label, i, len(order), need, stride) for i in range(len(order) - need + 1)]
        strides[stride] = sorted({*strides.get(stride, ()), *(by_rank[t] for t in order[: len(order) - need + 1])})
        least[stride] = min(need, least.get(stride, need))
    blocks = blocks_of(text_words(docs, sorted({w for p in strides.values() for w in p})), strides)
    rank_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, ranks[w])])
    known = F.array_distinct(F.filter("block", lambda w: w.isin(*vocabulary)))
    few = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("stride")]
    blocks = blocks.select("doc_id", "text_hash", "stride", known.alias("known"), few.alias("least")).where(F.size("known") >= F.col("least"))
    blocks = blocks.select("doc_id", "text_hash", "stride", "least", F.array_sort(F.transform("known", lambda w: rank_of[w])).alias("ids")) \
        .withColumn("n", F.size("ids"))
    met = blocks.select("*", F.posexplode(F.slice("ids", F.lit(1), F.col("n") - F.col("least") + 1)).alias("at", "token")).drop("least")
    spark = docs.sparkSession
    entries = spark.createDataFrame(index, "token int, template int, label string, place int, size int, need int, stride int")
    left = F.least(F.col("n") - F.col("at"), F.col("size") - F.col("place"))
    # one row per token of the templates' prefixes: bounded by the templates
    pairs = met.join(F.broadcast(entries), ["token", "stride"]).where((F.col("n") >= F.col("need")) & (left >= F.col("need")))
    all_members = F.array(*[literal_array(m, "int") for m in members])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("ids", F.get(all_members, F.col("template"))))).where("shared >= need")
    return pairs.groupBy("doc_id", "text_hash", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per document: phrase counts and places, labels, and the best containment."""
    matches = block_matches(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("score"))  # a set of at most all labels
    m = matches.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "more", "score")
    base = base_columns(docs, phrases)
    joined = base.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    text = lambda c: F.concat_ws(",", F.array_sort(c))
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("found")).alias("base_labels"),
        text(F.array_union("found", F.coalesce("more", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
