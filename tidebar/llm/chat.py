"""Chat formatting by typed content parts.

A visitor walks the parts of each turn in order. Text parts are escaped; image, audio and
document parts become numbered placeholders, and an attachment record keeps their place,
reference, source and the tokens they expand to. Plain texts are cut into parts first:
an inline link ``![alt](reference)`` is a part of the kind its ending tells, all else text.

A conversation is formatted turn by turn: one output row per turn, with the turn's piece of
the conversation, the loss mask in it and its attachments. Tasks hold one batch at a time,
whatever the length of a conversation.

Template: ``<|start|>ROLE<|text|>TEXT<|end|>``. Control strings inside texts and roles get
one backslash after their first character, and one more if they already have some; that is
undone exactly by taking one away.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own;
turns are ordered by turn (null first), then role, text and parts, so repeated rows and ties
have one order; an empty text is a turn with nothing under the loss mask; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.base import map_batches

# The template's controls, and other chat formats' control strings by what
# may follow their first character.
START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"(<(?=\\*(?:\||/?s>|</?SYS>>))|\[(?=\\*/?INST\]))")
ESCAPED = re.compile(r"(<(?=\\+(?:\||/?s>|</?SYS>>))|\[(?=\\+/?INST\]))\\")
LINK = re.compile(r"!\[[^\]\n]*\]\(([^)\s]+)\)")
PIECE = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*)<\|end\|>", re.S)
PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|(\d+)\|>")

# Kinds by file ending, and the tokens an attachment expands to.
KINDS = {"png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image",
         "wav": "audio", "mp3": "audio", "ogg": "audio", "flac": "audio"}
EXPANDED = {"image": 576, "audio": 750, "document": 1024}

PARTS = "array<struct<type string, text string, ref string, tokens bigint>>"
ATTACHMENTS = "array<struct<number bigint, kind string, ref string, source string, tokens bigint, at bigint>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parts_of(text: str) -> list[dict]:
    """A plain text as typed parts, whose sources make up the text again."""
    out, at = [], 0
    for m in LINK.finditer(text):
        if m.start() > at:
            out.append({"type": "text", "text": text[at : m.start()]})
        kind = KINDS.get(m[1].rpartition(".")[2].lower(), "document")
        out.append({"type": kind, "text": m[0], "ref": m[1], "tokens": None})
        at = m.end()
    if at < len(text):
        out.append({"type": "text", "text": text[at:]})
    return out


class Visitor:
    """Flattens parts in order; numbers attachments from ``first`` on."""

    def __init__(self, first: int = 0):
        self.number, self.out, self.at, self.attachments = first, [], 0, []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def emit(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def visit_text(self, part: dict) -> None:
        self.emit(part.get("text") or "")

    def attach(self, part: dict) -> None:
        kind, tokens = part["type"], part.get("tokens")
        self.attachments.append({
            "number": self.number, "kind": kind, "ref": part.get("ref"), "source": part.get("text") or "",
            "tokens": EXPANDED[kind] if tokens is None else tokens, "at": None})
        self.out.append(self.attachments[-1])
        self.number += 1

    visit_image = visit_audio = visit_document = attach

    def flat(self) -> tuple[str, list[dict]]:
        """The escaped text with placeholders, and the attachments with their places in it.

        Neighbouring texts are joined before escaping, as a control string could lie across.
        """
        pieces, run, size = [], [], 0

        def flush():
            nonlocal size
            if run:
                pieces.append(escape("".join(run)))
                size += len(pieces[-1])
                run.clear()

        for x in self.out:
            if isinstance(x, str):
                run.append(x)
            else:
                flush()
                x["at"] = size
                pieces.append(f"<|{x['kind']}|{x['number']}|>")
                size += len(pieces[-1])
        flush()
        return "".join(pieces), self.attachments


def format_turn(role: str, parts: list[dict], first: int) -> tuple[str, int, int, list[dict]]:
    """The turn's piece, start and length of its loss mask in it, its attachments."""
    v = Visitor(first)
    for p in parts:
        v.visit(p)
    body, attachments = v.flat()
    head = f"{START}{escape(role)}{TEXT}"
    for a in attachments:
        a["at"] += len(head)
    loss = role == "assistant" and bool(body)
    return head + body + END, len(head) if loss else 0, len(body) if loss else 0, attachments


def restore(body: str, attachments: list[dict]) -> str:
    """The text that a body was made of."""
    by_number = {a["number"]: a["source"] for a in attachments}
    out, at = [], 0
    for m in PLACEHOLDER.finditer(body):
        out += [unescape(body[at : m.start()]), by_number[int(m[2])]]
        at = m.end()
    return "".join([*out, unescape(body[at:])])


FORMATTED = f"conv_id long, turn_no long, piece string, loss_start long, loss_length long, attachments {ATTACHMENTS}"
_ATTACHED = pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                                ("source", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per turn, in the order of turns; ``parts`` names a column of typed parts
    (type, text, ref, tokens) that stands in for the text where it is not null."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.col(parts) if parts else F.lit(None)).cast(PARTS).alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", F.to_json("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn_no, attached = object(), 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv_id"] != conv:
                    conv, turn_no, attached = r["conv_id"], 0, 0
                given = r["parts"] if r["parts"] is not None else parts_of(r["text"])
                piece, start, length, attachments = format_turn(r["role"], given, attached)
                out.append((conv, turn_no, piece, start, length, attachments))
                turn_no, attached = turn_no + 1, attached + len(attachments)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, _ATTACHED))]
                if out else [pa.array([], t) for t in (*[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, _ATTACHED)],
                names=["conv_id", "turn_no", "piece", "loss_start", "loss_length", "attachments"])

    return map_batches(rows, run, FORMATTED)


DIGEST = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
          "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_attachments": pa.int64(),
          "expanded_tokens": pa.int64()}


class _Reading:
    """What has been read back of one conversation."""

    def __init__(self, conv):
        self.conv, self.counts = conv, dict.fromkeys(("turns", "loss", "chars", "attached", "tokens"), 0)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, r: dict) -> None:
        m = PIECE.fullmatch(r["piece"])
        if m is None:
            raise ValueError(f"conversation {self.conv}, turn {r['turn_no']}: not a formatted turn")
        attachments = r["attachments"] or []
        self.turns.update(f"{unescape(m[1])}\n{restore(m[2], attachments)}\n".encode("utf-8", "replace"))
        masked = restore(r["piece"][r["loss_start"] : r["loss_start"] + r["loss_length"]], attachments)
        self.loss.update(masked.encode("utf-8", "replace"))
        for k, n in (("turns", 1), ("loss", len(masked)), ("chars", len(r["piece"])), ("attached", len(attachments)),
                     ("tokens", sum(a["tokens"] for a in attachments))):
            self.counts[k] += n

    def row(self) -> tuple:
        c = self.counts
        return (self.conv, c["turns"], self.turns.hexdigest(), c["loss"], self.loss.hexdigest(), c["chars"],
                c["attached"], c["tokens"])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted pieces alone."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[] for _ in DIGEST]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, DIGEST.values())], names=list(DIGEST))

        for b in batches:
            for r in b.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(r["conv_id"])
                now.add(r)
            yield out()
        if now is not None:
            done.append(now.row())
            yield out()

    return map_batches(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
