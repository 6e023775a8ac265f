"""Secret scans: patterns, and guess-cost dynamic programming on credential values.

A value next to a credential word that no base pattern covers is split, at minimum cost,
into words, dates, repeats, keyboard walks and brute-force spans. The cost of a split is
the sum of log10 guesses of its spans; values that cost at least ``min_cost`` in all and
``per_char`` a character are secrets, so that a long run of words is none.

Words are a few fixed ones and the corpus's own: at most ``most`` words, those in the most
documents (at least two), ranked, counted in Spark over all whole texts. What stands as a value next
to a credential word isn't counted, so a secret that is copied a thousand times doesn't
become a word. The program alone decides; a word that the corpus has nowhere else costs as
much as random letters.

Defined results: a null or empty text has no spans; repeated rows give equal rows; an
empty table gives no rows; only doc_id and text are read. The program's cost is linear in
the length of a value, as no span but brute force is longer than 32 characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.base import map_batches, texts
from tidebar.session import staged

KINDS = ("assign", "access", "hex", "credential")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Credential words beyond the base ones; what joins them to a value; the value.
CONTEXT = re.compile(
    r"""(?i:pass(?:phrase|code|word)?|pwd|passwd|credentials?|bearer|authorization|auth|private_?key|access_?key|api_?key|secret|token)"""
    r"""["']?[ \t]*(?:[:=]|=>|\bis\b)[ \t]*(?i:bearer[ \t]+|basic[ \t]+)?["']?([^\s"'<>]{8,})""", re.A)

# Every match of the two patterns has one of these in lower case: a fast first look.
HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "bearer", "auth")

# Common words and passwords, by rank; keyboard rows.
COMMON = (
    "password 123456 qwerty letmein admin welcome login monkey dragon master secret hello love test user "
    "pass football baseball sunshine princess shadow superman iloveyou trustno1 abc123 root guest changeme "
    "default summer winter spring autumn monday friday january june july august the and you that this with "
    "from have not for are was all one time year day home work life world money computer internet system "
    "server account email name open close key value example sample string true false null none"
).split()
RANKS = {w: i + 1 for i, w in enumerate(COMMON)}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?$")
LEET = str.maketrans("@40135$7", "aaoiess" + "t")
LONGEST = 32
MOST_WORDS, MIN_COST, PER_CHAR = 50_000, 10.0, 0.9


def corpus_ranks(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Word to rank: the corpus's words by the number of documents, and the fixed ones by theirs.

    A word is counted once a document, and added up before the shuffle. The counts are cut at
    one of eight steps a doubling, the lowest with at most ``most`` words above it, so the driver
    gets that many rows at most, whatever the number of tasks.
    """
    text = F.col("text")
    prose = F.when(text.rlike("(?i)" + "|".join(HINTS)), F.regexp_replace(text, CONTEXT.pattern, " ")).otherwise(text)
    words = F.filter(F.split(F.lower(prose), r"\P{L}+"), lambda w: F.length(w).between(3, LONGEST))
    count = texts(docs).select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    count = staged(count.where("n >= 2").withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "secret-words")
    cut, total = None, 0
    for r in count.groupBy("step").agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():  # at most 8 x 63 steps
        total += r["k"]
        if total > most:
            break
        cut = r["step"]
    top = sorted(count.where(F.col("step") >= cut).collect(), key=lambda r: (-r["n"], r["w"])) if cut is not None else []
    ranks = {r["w"]: i + 1 for i, r in enumerate(top)}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in RANKS.items()}


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest split needs, and that split as (kind, start, end)."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    repeat = walk = 0  # lengths of the repeat and the walk that end here
    for end in range(1, n + 1):
        i = end - 1
        offer = best[i] + _char_cost(value[i])
        best[end], back[end] = offer, ("brute", i)
        repeat = repeat + 1 if i and value[i] == value[i - 1] else 1
        walk = walk + 1 if i and (low[i - 1], low[i]) in NEXT else 1
        for kind, length, cost in (("repeat", repeat, 0.0), ("walk", walk, math.log10(47 * 4))):
            if length >= 3:
                start = end - length
                price = best[start] + (cost or _char_cost(value[i])) + math.log10(length)
                if price < best[end]:
                    best[end], back[end] = price, (kind, start)
        for start in range(max(0, end - LONGEST), end - 2):
            word = plain[start:end]
            rank = ranks.get(low[start:end]) or ranks.get(word)
            if rank:
                price = best[start] + math.log10(rank + 1) + 0.3 * (value[start:end] != low[start:end])
                price += 0.3 * (word != low[start:end])
                if price < best[end]:
                    best[end], back[end] = price, ("word", start)
        for length in (4, 8, 10):
            if end >= length and value[end - length].isdigit() and DATE.match(value[end - length : end]):
                price = best[end - length] + (2.1 if length == 4 else 4.6)
                if price < best[end]:
                    best[end], back[end] = price, ("date", end - length)
    split, end = [], n
    while end:
        kind, start = back[end]
        if kind == "brute" and split and split[-1][0] == "brute" and split[-1][1] == end:
            split[-1] = ("brute", start, split[-1][2])
        else:
            split.append((kind, start, end))
        end = start
    return best[n], split[::-1]


def find_secrets(
    text: str, ranks: dict[str, int] = RANKS, min_cost: float = MIN_COST, per_char: float = PER_CHAR
) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """The base spans, and the further credential values with their guess costs."""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if hinted else []
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    more = []
    for m in CONTEXT.finditer(text) if hinted else ():
        value = m[1].rstrip(".,;:)]}")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) < 8 or any(s < end and start < e for _, s, e in base):
            continue
        cost, _ = guess_cost(value, ranks)
        if cost >= max(min_cost, per_char * len(value)):
            more.append(("credential", start, end, cost))
    return base, more


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digest(text: str, ranks: dict[str, int], min_cost: float) -> tuple:
    base, more = find_secrets(text, ranks, min_cost)
    every = sorted([*base, *(s[:3] for s in more)], key=lambda s: (s[1], KINDS.index(s[0])))
    count = lambda kind: sum(s[0] == kind for s in base)
    return (count("assign"), count("access"), count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(),
            joined(every), max((s[3] for s in more), default=None))


COLUMNS = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(),
           "spans": pa.string(), "top_guess_cost": pa.float64()}


def scan_secrets(docs: DataFrame, min_cost: float = MIN_COST, most: int = MOST_WORDS) -> DataFrame:
    """One row per document: counts, spans and the highest guess cost of a credential value."""
    ranks = corpus_ranks(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(t, ranks, min_cost) for t in b.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(columns, COLUMNS.values())]], names=["doc_id", *COLUMNS])

    return map_batches(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, "
                                         "base_sha256 string, spans string, top_guess_cost double")


def redact_secrets(docs: DataFrame, min_cost: float = MIN_COST, mark: str = "[SECRET]", most: int = MOST_WORDS) -> DataFrame:
    """The documents with every span replaced by ``mark``, all columns kept; n_chars follows
    the text where the table has it. A null text stays null."""
    ranks = corpus_ranks(docs, most)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def redact(text: str | None) -> str | None:
        if not text:
            return text
        base, more = find_secrets(text, ranks, min_cost)
        out, done = [], 0
        for _, start, end in sorted([*base, *(s[:3] for s in more)], key=lambda s: s[1:]):
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join([*out, text[done:]]) if done else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, old = list(b.columns), b.column(at).to_pylist()
            new = [redact(t) for t in old]
            columns[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                n = [len(t) if t is not None and t != o else c for t, o, c in zip(new, old, b.column(size).to_pylist())]
                columns[size] = pa.array(n, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(docs, run, docs.schema)
