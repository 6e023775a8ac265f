"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (a run of capitalised words is one) and units after a
number turn into typed placeholders, everything else into lower-case words. White space is one
blank first. Whether the word that begins a sentence is a name can't be told from its form, so
texts have three readings: such words plain, such words names, and literal (no placeholders).
Windows of 8 words of a reading are hash-joined with those of the benchmark. Where windows meet,
their words are compared, and the placeholders' values (slots) of one occurrence have to be a
mapping: the same name or number of the item is always the same one in the document. So a
question asked again with other names and numbers is found, a mere likeness of form is not.

DataFrame functions only. All windows of all documents are probed against the distinct
hashes of the benchmark's windows; the optimizer broadcasts those hashes only where the
written table is small. What meets is counted by document before it goes on; a passage that
very many documents share costs each of them a few rows.

Defined results: null or empty texts have no windows; an item with fewer than 5 words is no
evidence and finds nothing, one with 5 to 7 words is one window; a window needs 4 different
words that are no placeholders, so windows poor in them are met by the literal reading alone, and
shares are of a reading's windows that meet this; repeated rows count once in the pairs; null ids are kept as they are; empty
tables give no rows; columns besides the id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.base import texts
from tidebar.session import staged

WINDOW, SHORTEST, PLAIN = 8, 5, 4

# Units after a number, and the placeholders (private characters).
UNITS = (
    "km kg cm mm ml mg m g l s h min hours hour minutes minute seconds second days day weeks week months month years year "
    "dollars dollar euros euro cents cent meters meter miles mile feet foot inches inch pounds pound degrees degree percent"
).split()
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
PLAIN_START, NAME_START, LITERAL = READINGS = range(3)
_RUN = r"\p{Lu}[\p{L}\p{M}]*+(?: \p{Lu}[\p{L}\p{M}]*+)*+"
NAME_RE = {PLAIN_START: rf"(?<=[^\s.!?:;] ){_RUN}", NAME_START: rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_RUN}"}
NUMBER_RE = r"[0-9]+(?:[.,:/][0-9]+)*"
_UNIT = r" ?(?:" + "|".join(UNITS) + r")(?![\p{L}\p{M}])"
SLOT_RE = f"|{NUMBER_RE}|(?<=[0-9]){_UNIT}"  # after NAME_RE


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, NUMBER + NAME + UNIT, ""), r"[\s\x{85}\p{Z}]+", " "))


def _known_names(clean: Column) -> Column:
    """NAME_RE of plain starts, and a start whose first word is a name elsewhere in the text."""
    inside = F.array_join(F.regexp_extract_all(clean, F.lit(NAME_RE[PLAIN_START]), 0), " ")
    again = F.concat(F.lit(rf"|(?<![\p{{L}}\p{{M}}\p{{N}}])(?:"), F.replace(inside, F.lit(" "), F.lit("|")), F.lit(rf")(?![\p{{L}}\p{{M}}])(?: {_RUN})?+"))
    return F.concat(F.lit(NAME_RE[PLAIN_START]), F.when(inside != "", again).otherwise(""))


def _template(clean: Column, reading: int, names: Column | None = None) -> Column:
    out = clean
    if reading != LITERAL:
        out = F.regexp_replace(out, F.lit(NAME_RE[reading]) if names is None else names, F.lit(f" {NAME} "))
        out = F.regexp_replace(out, NUMBER_RE, f" {NUMBER} ")
        out = F.regexp_replace(out, f"(?<={NUMBER} ){_UNIT}", f" {UNIT} ")
    out = F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}{UNIT}]+", " ")
    return F.split(F.trim(out), " ")  # a text without words is one empty word, under any window


def _values(clean: Column, reading: int, names: Column | None = None) -> Column:
    if reading == LITERAL:
        return F.array().cast("array<string>")
    slot = F.concat(F.lit(NAME_RE[reading]) if names is None else names, F.lit(SLOT_RE))
    return F.transform(F.regexp_extract_all(clean, slot, 0), lambda s: F.trim(s))


def template_words(text: Column, reading: int = PLAIN_START) -> Column:
    """The words of the text's template."""
    return _template(_clean(text), reading)


def slots(text: Column, reading: int = PLAIN_START) -> Column:
    """The values that became placeholders, in order."""
    return _values(_clean(text), reading)


def _read(df: DataFrame, text: str, values: bool, readings=READINGS, item: bool = False) -> DataFrame:
    """The text column as (reading, w), with ``values`` also the slots: one row per reading.
    An item's plain starts are names where the item has them as names inside a sentence."""
    keep = [c for c in df.columns if c != text]
    names = lambda k: F.col("names") if item and k == PLAIN_START else None
    one = lambda k: F.struct(
        F.lit(k).alias("reading"), _template(F.col("clean"), k, names(k)).alias("w"),
        *([_values(F.col("clean"), k, names(k)).alias("values")] if values else []))
    df = df.select(*keep, _clean(F.col(text)).alias("clean"))
    if item:
        df = df.withColumn("names", _known_names(F.col("clean")))
    return df.select(*keep, F.inline(F.array(*[one(k) for k in readings])))


def item_windows(benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """(hash, item_id, reading, at, size, windows, words, item_slots) of every window that is evidence."""
    items = benchmark.select(F.col(key).cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    items = _read(items.withColumn("item", F.xxhash64("t")), "t", True, item=True)
    items = items.where(F.size("w") >= SHORTEST).withColumn("size", F.least(F.lit(WINDOW), F.size("w")))
    rows = items.select("item_id", "item", "reading", "size", "w", "values", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    rows = rows.withColumn("words", F.slice("w", F.col("at"), F.col("size")))
    plain = F.array_distinct(F.filter("words", lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    rows = rows.where(F.size(plain) >= PLAIN)
    count = rows.groupBy("item_id", "item", "reading").agg(F.count("*").cast("int").alias("windows")) \
        .select(F.col("item_id").alias("c_id"), F.col("item").alias("c_item"), F.col("reading").alias("c_reading"), "windows")
    rows = rows.join(count, F.col("item_id").eqNullSafe(F.col("c_id")) & (F.col("item") == F.col("c_item")) & (F.col("reading") == F.col("c_reading")))
    return rows.select(
        _window_hash(_word_hashes("words"), F.lit(1), F.col("size")).alias("hash"), "item_id", "item", "reading", "at", "size", "windows", "words",
        _window_slots("w", "at", "words", "values").alias("item_slots"))


def _window_slots(words: str, at: str, window: str, values: str) -> Column:
    """The slot values of a window: as many as it has placeholders, after those before it."""
    places = f"array('{NUMBER}', '{NAME}', '{UNIT}')"
    count = lambda a: f"size(filter({a}, w -> array_contains({places}, w)))"
    return F.expr(f"slice({values}, {count(f'slice({words}, 1, {at} - 1)')} + 1, {count(window)})")


def _word_hashes(words: Column | str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hash(h: Column, at: Column, size: Column) -> Column:
    """Of ``size`` word hashes from place ``at`` (from 1) on."""
    one = lambda k: F.xxhash64(*[F.get(h, at + (i - 1)) for i in range(k)])
    out = F.when(size == WINDOW, one(WINDOW))
    for k in range(SHORTEST, WINDOW):
        out = out.when(size == k, one(k))
    return out


def _hashed_readings(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, readings, h: the hashes of the words, once for readings that are equal.

    A text without a number and without a name inside a sentence has no placeholder when its
    starts are plain, so that reading is the literal one.
    """
    docs = docs.select("doc_id", "text_hash", _clean(F.col("text")).alias("clean"))
    docs = docs.withColumn("slotted", F.col("clean").rlike(f"[0-9]|{NAME_RE[PLAIN_START]}")) \
        .withColumn("literal", _word_hashes(_template(F.col("clean"), LITERAL)))
    one = lambda readings, h: F.struct(F.array(*map(F.lit, readings)).alias("readings"), h.alias("h"))
    starts = one([NAME_START], _word_hashes(_template(F.col("clean"), NAME_START)))
    plain = one([PLAIN_START], _word_hashes(_template(F.col("clean"), PLAIN_START)))
    each = F.when(F.col("slotted"), F.array(plain, starts, one([LITERAL], F.col("literal")))) \
        .otherwise(F.array(starts, one([PLAIN_START, LITERAL], F.col("literal"))))
    return docs.select("doc_id", "text_hash", F.inline(each))


def matched_windows(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per meeting of a document's window with an item's, words compared."""
    items = staged(item_windows(benchmark, key), "item-windows")
    hashes = staged(items.select("hash").distinct(), "item-hashes")
    sizes = [(r["reading"], r["size"]) for r in items.select("reading", "size").distinct().collect()]  # few: readings x window sizes
    docs = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    words = _hashed_readings(docs)
    wanted = F.array().cast("array<int>")
    for readings in ([PLAIN_START], [NAME_START], [LITERAL], [PLAIN_START, LITERAL]):
        mine = sorted({n for k, n in sizes if k in readings})
        if mine:
            wanted = F.when(F.col("readings") == F.array(*map(F.lit, readings)), F.array(*map(F.lit, mine))).otherwise(wanted)
    # windows come as rows, so that their hashes are compiled code
    words = words.select("*", F.explode(wanted).alias("n"))
    places = F.when(F.size("h") >= F.col("n"), F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("h") - F.col("n") + 1)))
    probe = words.select("doc_id", "text_hash", "readings", "h", "n", F.explode(places).alias("at")) \
        .select("doc_id", "text_hash", "readings", "at", "n", _window_hash(F.col("h"), F.col("at"), F.col("n")).alias("hash"))
    hit = staged(probe.join(hashes, "hash", "left_semi"), "hits").withColumn("reading", F.explode("readings")).distinct()
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.col("reading").alias("hit_reading"), F.col("at").alias("place"), "n", "hash")
    # only documents with a hit are read again, for the words and values of the windows met
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & (F.col("text_hash") == F.col("hit_hash"))
    found = docs.join(staged(hit.select("hit_id", "hit_hash").distinct(), "hit-docs"), same("doc_id", "hit_id"), "left_semi") \
        .dropDuplicates(["doc_id", "text_hash"])
    found = _read(found, "text", True)
    met = hit.join(found, same("doc_id", "hit_id") & (F.col("reading") == F.col("hit_reading")))
    # a window's own words and values go on, not the whole document's
    met = met.select("doc_id", "text_hash", "hash", "hit_reading", "place", F.slice("w", F.col("place"), F.col("n")).alias("met_words"),
                     _window_slots("w", "place", "met_words", "values").alias("doc_slots"))
    met = met.join(items, "hash").where((F.col("reading") == F.col("hit_reading")) & (F.col("met_words") == F.col("words")))
    return met.select("doc_id", "text_hash", "item_id", "item", "reading", "at", "place", "windows", "item_slots", "doc_slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.4, key: str = "item_id") -> DataFrame:
    """(doc_id, item_id) pairs with the share of the item's windows of a reading found in one
    occurrence whose slots are consistent, and whether all its slots are the item's own."""
    met = matched_windows(docs, benchmark, key)
    pair = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    places = met.withColumn("pair", F.explode_outer(F.transform(pair, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))))
    by = ["doc_id", "text_hash", "item_id", "item", "reading", "windows", F.expr("place - at").alias("start")]
    # an occurrence has at most as many windows and slots as its item
    seen = places.groupBy(*by).agg(F.countDistinct("at").alias("n"), F.collect_set("pair").alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs")
    seen = seen.where(consistent & (F.col("n") >= share * F.col("windows"))).withColumn("exact", F.forall("pairs", lambda p: p["i"] == p["d"]))
    return seen.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n").alias("n_windows"), F.max(F.col("n") / F.col("windows")).alias("share"), F.max("exact").alias("exact"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.4) -> DataFrame:
    """The documents without any pair, all columns kept."""
    bad = staged(contaminated(docs, benchmark, share).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(text) == bad["bad_hash"]), "left_anti")
