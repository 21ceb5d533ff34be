"""Chat formatting with typed content parts, a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import mapped

#: A turn's content: parts of type text (text set) or image, audio, document (uri and size set).
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
SEGMENT = "n long, role string, formatted string, plain string, loss_start long, loss_end long, attachments array<string>, attachment_tokens long"
SEGMENT_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("plain", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.string())), ("attachment_tokens", pa.int64())]
)
READ_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64())])

# The template's control strings. Inside a text each gets a backslash after its first character.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?TURN[ >]|\|(?:image|audio|document):)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?TURN[ >]|\|(?:image|audio|document):)")
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
TURN = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|<s>(?P<assistant>.*)</s>|<TURN (?P<role>.*?)>(?P<other>.*)</TURN>", re.DOTALL)


def escape(text: str) -> str:
    """text with every control string broken by one more backslash than it had."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class Flatten:
    """Visitor over content parts: texts next to each other are joined and escaped, every other part becomes a numbered placeholder.

    Joining comes first, so no control string can arise where two texts meet. attachments lists the
    references in order, tokens adds up what the placeholders stand for: an image one token for each
    14 x 14 patch of pixels, audio 25 a second, a document 512 a page; sizes that are null, negative or
    no number count nothing. A part of an unknown type is a document; a null part is nothing.
    """

    PATCH, AUDIO_RATE, PAGE = 14, 25, 512

    def __init__(self) -> None:
        self.attachments: list[str] = []
        self.tokens = 0
        self.out: list[str] = []
        self.waiting: list[str] = []

    def flatten(self, parts: list[dict | None]) -> str:
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part)
        self.close_text()
        return "".join(self.out)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, -(-self.size(part, "width") // self.PATCH) * -(-self.size(part, "height") // self.PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(self.size(part, "seconds") * self.AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.size(part, "pages") * self.PAGE)

    @staticmethod
    def size(part: dict, name: str) -> float:
        value = part.get(name) or 0
        return value if math.isfinite(value) and value > 0 else 0

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close_text()
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append(part.get("uri") or "")
        self.tokens += int(tokens)

    def close_text(self) -> None:
        self.out.append(escape("".join(self.waiting)))
        self.waiting = []


def format_turn(role: str, parts: list[dict | None]) -> tuple[str, int, int, Flatten]:
    """The turn's segment, where its trained span starts and ends in it (both 0 if none), and what was flattened."""
    visitor = Flatten()
    body = visitor.flatten(parts)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0, visitor
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body), visitor
    return f"<TURN {quote(role, safe='')}>{body}</TURN>", 0, 0, visitor


def read_parts(body: str, attachments: list[str]) -> list[tuple[str, str]]:
    """(type, text or reference) of each part of a turn's body as it stands in a segment: texts unescaped, placeholders with their references."""
    found, at = [], 0
    for m in PLACEHOLDER.finditer(body):
        if m.start() > at:
            found.append(("text", unescape(body[at : m.start()])))
        found.append((m[1], attachments[int(m[2])]))
        at = m.end()
    return [*found, ("text", unescape(body[at:]))] if at < len(body) else found


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted segment; placeholders stay in the text."""
    m = TURN.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    for role in ("user", "assistant"):
        if m[role] is not None:
            return role, unescape(m[role])
    return unquote(m["role"]), unescape(m["other"])


def parts_of_text(column: str = "text"):
    """A column of plain texts as content of one text part; null is the empty text."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(column), F.lit("")).alias("text"), *empty)).cast(PARTS)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, content) as formatted segments, in order inside each conversation.

    A conversation is the concatenation of its segments in the order of n (turn, then role and content
    where turns tie; null turns first). Rows are dealt by conversation and sorted by Spark; tasks
    stream through them, so a conversation of any length is never held whole. A null role is the
    empty role, null content is an empty text; rows without conv_id form one conversation of their own;
    repeated rows are turns of their own; an empty table gives no rows; other columns are not read.
    """

    names = ["conv_id", *(c.split()[0] for c in SEGMENT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n = object(), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n = n + 1 if row["conv_id"] == current else 0
                current, role, parts = row["conv_id"], row["role"] or "", row["content"] or []
                segment, start, end, seen = format_turn(role, parts)
                plain = "".join(p["text"] or "" for p in parts if p is not None and (p["type"] or "text") == "text")
                out.append(dict(zip(names, (current, n, role, segment, plain, start, end, seen.attachments, seen.tokens), strict=True)))
            yield pa.RecordBatch.from_pylist(out, SEGMENT_TYPES)

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "content").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")
    return mapped(ordered.drop("turn"), run, f"conv_id long, {SEGMENT}")


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted segments alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments.

    segments must come from format_turns in the same plan (dealt and sorted by conversation); digests
    are updated turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def closed() -> list:
            return [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in state]] if state else []

        def frame(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(READ_TYPES.names, r, strict=True)) for r in rows], READ_TYPES)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["n"] == 0:
                    out += closed()
                    state[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                segment = row["formatted"]
                role, text = read_turn(segment)
                trained = unescape(segment[row["loss_start"] : row["loss_end"]])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(trained)
                state[4].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
                state[6] += len(PLACEHOLDER.findall(segment))
            yield frame(out)
        yield frame(closed())

    columns = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"
    return mapped(segments.select("conv_id", "n", "formatted", "loss_start", "loss_end"), run, columns)
