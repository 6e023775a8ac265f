"""Quality rules: distribution divergence of a document from language references.

A reference is the pooled histogram of all documents of one language: character classes,
and the language's common words against all other words. A document is measured against
every reference with the Jensen-Shannon distance (base 2, square root) and takes the
nearest of each kind, so a wrong language label costs nothing. Documents shorter than the guards are
not judged by divergence, as their histograms say too little.

A label serves as a reference if its documents hold at least half the pooled share of common
words, or are written mostly in letters beyond ASCII; so text without words is no standard for
itself, whatever its label. Beside the whole word histogram, which varies much in short documents,
the share of common words is compared alone: with each list against its label, with all lists
against the corpus. Its limit is a part of the distance of a text without any common word, so such
a text fails in every corpus that has common words. Documents mostly in letters beyond ASCII are
not judged by that share.

Defined results: a null or empty text has no words and fails the base rule; a null
language counts into the pooled reference of all languages only; repeated rows are judged
alike; an empty table gives no rows; columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.base import batch, map_batches, texts
from tidebar.session import staged

# Common words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is it that for on was with as are by be at this from or an have not you",
    "fr": "le la les de des du et un une que qui en dans est pour pas par sur au avec il elle ce plus ne",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "el la los de que y en un una por con no para es se del las al lo como su ha más pero sus",
}
# Characters that count as symbols, and as punctuation of prose.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
SPACES = " \t\n\x0b\x0c\r"

WORDS = {w: i for i, w in enumerate(sorted({w for ws in COMMON_WORDS.values() for w in ws.split()}))}
N_CLASSES = 10  # a-z, A-Z, 0-9, white space, punctuation, symbols, other ASCII, 2-, 3- and 4-byte letters


def _byte_classes() -> np.ndarray:
    """The class of each UTF-8 byte; continuation bytes get a class beyond the last."""
    out = np.full(256, 6, np.uint8)
    for lo, hi, k in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        out[ord(lo) : ord(hi) + 1] = k
    for chars, k in ((SPACES, 3), (PUNCTUATION, 4), (SYMBOLS, 5)):
        out[[ord(c) for c in chars]] = k
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = N_CLASSES, 7, 8, 9
    return out


BYTE_CLASSES = _byte_classes()
STRIP = (PUNCTUATION + SYMBOLS).encode()
ALL_WORDS = np.arange(len(WORDS))
LISTS = {lang: np.array([WORDS[w] for w in sorted(set(ws.split()))]) for lang, ws in COMMON_WORDS.items()}


def char_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(BYTE_CLASSES[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Counts of the common words, and of all others in the last place."""
    out = np.zeros(len(WORDS) + 1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    for w, n in seen.items():
        out[WORDS.get(w.lower().strip(STRIP).decode("utf-8", "replace"), -1)] += n
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors: 0 equal, 1 disjoint."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def shares(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Counts of the words at ``places`` of a word histogram, and of all others."""
    n = h[places].sum()
    return np.array([n, h.sum() - n], float)


def other_letters(h: np.ndarray) -> bool:
    """Whether most letters of a character histogram are beyond ASCII."""
    return bool(h[7:].sum() > h[:2].sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(SPACES):
            seen.add(line)
    n = len(words)
    if n < 4:
        return word_chars, symbols, duplicates, 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:] if k < 2_000_000 else None
    if windows is None:  # the product would not fit: number the pairs first
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        windows = pairs[:-1] * k + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return word_chars, symbols, duplicates, int(covered.sum())


def language_references(docs: DataFrame, languages: int = 64) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Pooled histograms of all documents, by language and (None) of all together.

    The counts cover every document. Only the ``languages`` with the most characters get a
    reference of their own; what comes to the driver is at most that many short rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str | None, np.ndarray] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8", "replace")
                h = np.concatenate([char_histogram(raw), word_histogram(raw.split())])
                sums[lang] = sums[lang] + h if lang in sums else h
            yield batch(["lang", "h"], [list(sums), [v.tolist() for v in sums.values()]],
                        [pa.string(), pa.list_(pa.int64())])

    n = N_CLASSES + len(WORDS) + 1
    parts = map_batches(texts(docs, "lang").select("text", F.col("lang").cast("string")), count,
                        "lang string, h array<bigint>")
    sums = staged(parts.groupBy("lang").agg(*[F.sum(F.col("h")[i]).alias(f"h{i}") for i in range(n)]), "histograms")
    total = sum((F.col(f"h{i}") for i in range(N_CLASSES)), F.lit(0))
    pooled = sums.agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(n)]).first()
    rows = sums.where("lang is not null").orderBy(total.desc(), "lang").limit(languages).collect()
    split = lambda v: (np.array(v[:N_CLASSES], float), np.array(v[N_CLASSES:], float))
    out = {r["lang"]: split([r[f"h{i}"] for i in range(n)]) for r in rows}
    if pooled is not None and pooled["h0"] is not None:
        out[None] = split([pooled[f"h{i}"] for i in range(n)])
    return out


class Rules:
    """What a document must meet; picklable, sent to the tasks."""

    def __init__(self, references, max_char=0.30, max_word=0.80, min_words=50, min_chars=200, max_common=0.60):
        share = lambda h: h[:-1].sum() / max(1, h.sum())
        least = share(references[None][1]) / 2 if None in references else 0.0
        served = {k: r for k, r in references.items() if k is None or share(r[1]) >= least > 0 or other_letters(r[0])}
        self.references = list(served.values())
        listed = [(LISTS[k], r[1]) for k, r in served.items() if k in LISTS] + [(ALL_WORDS, r[1]) for k, r in served.items() if k is None]
        pairs = [(places, shares(h, places)) for places, h in listed]
        self.common = [(places, q) for places, q in pairs if q[0] > 0]
        self.max_char, self.max_word = max_char, max_word
        bare = min((divergence(np.array([0.0, 1.0]), q) for _, q in self.common), default=1.0)
        self.max_common = max_common * bare
        self.min_words, self.min_chars = min_words, min_chars

    def judge(self, text: str) -> tuple:
        """n_words, the four base counts, base_failed, kept, char_distance, word_distance, common_distance."""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        n = len(words)
        counts = base_counts(text, words)
        failed = n < 50 or 100 * counts[3] > 50 * n
        chars = word = common = 0.0
        if n >= self.min_words and len(text) >= self.min_chars and self.references:
            c, w = char_histogram(raw), word_histogram(words)
            chars = min(divergence(c, rc) for rc, _ in self.references)
            word = min(divergence(w, rw) for _, rw in self.references)
            if self.common and not other_letters(c):
                common = min(divergence(shares(w, places), q) for places, q in self.common)
        kept = not failed and chars <= self.max_char and word <= self.max_word and common <= self.max_common
        return (n, *counts, failed, kept, chars, word, common)


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double",
    "common_distance": "double",
}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: the base counts, the distances and the verdict."""
    rules = Rules(language_references(docs), **limits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(rules.judge, b.column(1).to_pylist()))) or [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, _ARROW[t]) for c, t in zip(columns, COLUMNS.values())]],
                names=["doc_id", *COLUMNS])

    schema = "doc_id long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return map_batches(texts(docs), judge, schema)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns as they are."""
    rules = Rules(language_references(docs), **limits)
    at = docs.columns.index("text")
    kept = list(COLUMNS).index("kept")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([rules.judge(t or "")[kept] for t in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, judge, docs.schema)
