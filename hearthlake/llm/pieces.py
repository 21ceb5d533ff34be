"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearthlake.llm.shared import mapped, received, sent

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs beyond the worst piece (a fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: Segments of up to so many characters whose encoding a task remembers; when full, those of the fill before are forgotten.
REMEMBERED, SHORT = 50_000, 64
#: Characters from which a segment's paths are kept in packed arrays, 14 bytes for each.
LONG = 4096
#: Rows handed back at a time: texts, ids and decoded texts of a few hundred rows are in memory, never a partition.
ROWS = 256


class Vocabulary:
    """Pieces, scores and kinds read from a model file on the driver: a few MB at most."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.scores = [model.get_score(i) for i in ids]
        self.bytes_at = {int(self.pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.bytes_at.items():
            self.raw[i] = bytes([value])
        for i in ids:
            if model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""


class Steps:
    """The last piece of the best path to each place, as (length, id), in packed arrays."""

    def __init__(self, n: int):
        self.lengths, self.ids = array("H", bytes(2 * n)), array("i", bytes(4 * n))

    def __setitem__(self, at: int, step: tuple[int, int]) -> None:
        self.lengths[at], self.ids[at] = step

    def __getitem__(self, at: int) -> tuple[int, int]:
        return self.lengths[at], self.ids[at]


class Encoder(dict):
    """Segment to the ids of its best path as packed 32-bit integers; segments met before are looked up.

    A text is cut before every run of spaces and around characters that no piece holds. No piece
    spans such a cut, so the best path of the text is the best paths of its segments in a row.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.plain:
            self.automaton.add_word(vocabulary.pieces[i], (len(vocabulary.pieces[i]), vocabulary.scores[i], i))
        self.automaton.make_automaton()
        self.single = {vocabulary.pieces[i] for i in vocabulary.plain if len(vocabulary.pieces[i]) == 1}
        self.unknown_score = min(vocabulary.scores[i] for i in vocabulary.plain) - UNKNOWN_PENALTY
        spans_space = any(SPACE in vocabulary.pieces[i].lstrip(SPACE) for i in vocabulary.plain)
        lone = "".join(re.escape(c) for c in "\n\t" if not any(c in vocabulary.pieces[i] for i in vocabulary.plain))
        self.cut = re.compile("(?s).+" if spans_space else f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))

    def __missing__(self, segment: str) -> bytes:
        if len(segment) > SHORT:
            return array("i", self.viterbi(segment)).tobytes()
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        packed = self[segment] = self.before.get(segment) or array("i", self.viterbi(segment)).tobytes()
        return packed

    def viterbi(self, text: str) -> list[int] | array:
        """Ids of the path with the greatest sum of scores; of equal paths the one with the longest last piece.

        The automaton reports at each position every piece that ends there, following output links
        from the longest to the shortest; each relaxes the best score of its end. All paths to a
        start are settled before a piece from it is seen, so one pass is enough.
        """
        n = len(text)
        if n < LONG:
            best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        else:
            best, back = array("d", [0.0]) + array("d", [float("-inf")]) * n, Steps(n + 1)
        strange = None if self.single.issuperset(text) else bytearray(c not in self.single for c in text)
        settled = 0
        for last, (length, score, i) in self.automaton.iter(text):
            if strange:
                self.unknowns(strange, settled, last, best, back)
                settled = last
            total = best[last + 1 - length] + score
            if total > best[last + 1]:
                best[last + 1], back[last + 1] = total, (length, i)
        if strange:
            self.unknowns(strange, settled, n, best, back)
        ids = array("i") if n >= LONG else []
        while n:
            length, i = back[n]
            ids.extend((i,) if i >= 0 else self.unknown_ids(text[n - length : n]))
            n -= length
        return ids[::-1]

    def unknowns(self, strange: bytearray, begin: int, end: int, best: list[float], back: list[tuple[int, int]]) -> None:
        """Lets the characters from begin to end that are no piece themselves stand as unknown."""
        for at in range(begin, end):
            if strange[at] and best[at] + self.unknown_score > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.unknown_score, (1, -1)

    def unknown_ids(self, character: str) -> list[int]:
        """An unknown character as its bytes, last first; as the unknown id where the model has no bytes."""
        table = self.vocabulary.bytes_at
        return [table[b] for b in reversed(character.encode("utf-8", "surrogatepass"))] if table else [self.vocabulary.unknown]

    def encode(self, text: str) -> bytes:
        """Packed ids of a text. A space mark that the text itself holds goes in as bytes, so decoding gives it back."""
        if not text:
            return b""
        if SPACE in text:
            mark = array("i", self.unknown_ids(SPACE)[::-1]).tobytes()
            first, *rest = text.split(SPACE)
            parts = [self.run(SPACE + first.replace(" ", SPACE)), *(self.run(x.replace(" ", SPACE)) for x in rest)]
            return mark.join(parts)
        return self.run(SPACE + text.replace(" ", SPACE))

    def run(self, text: str) -> bytes:
        return b"".join([self[s] for s in self.cut.findall(text)])


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and bytes in a row, space marks as spaces, less the space put before the text."""
    raw = b"".join(map(vocabulary.raw.__getitem__, ids))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def as_lists(packed: list[bytes | None]) -> pa.Array:
    """Packed ids as a column of integer lists, without a Python object for each id."""
    ends = np.cumsum([0, *(len(p) // 4 if p else 0 for p in packed)])
    values = pa.array(np.frombuffer(b"".join(p for p in packed if p), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([p is None for p in packed]))


def encode_texts(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", path: str = MODEL) -> DataFrame:
    """docs with a column of ids for each text; null texts get null ids, empty ones an empty list.

    One row in, one row out, nothing moves between tasks; whole texts of any length, in memory that
    holds the rows of one batch and 14 bytes for each character of the longest run without spaces. A column named like ids_col is replaced; others pass through as they are.
    """
    carried = [c for c in docs.columns if c != ids_col]
    frame = docs.select(*carried)
    vocabulary = sent(frame.sparkSession, Vocabulary(path))
    at = carried.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(received(vocabulary))
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids = as_lists([None if t is None else encoder.encode(t) for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*carried, ids_col])

    return mapped(frame, run, T.StructType([*frame.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """encoded with the text that each list of ids stands for; null for null. Replaces a column named like out_col."""
    carried = [c for c in encoded.columns if c != out_col]
    frame = encoded.select(*carried)
    vocabulary = sent(frame.sparkSession, Vocabulary(path))
    at = carried.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(at)
                ids = lists.flatten().to_pylist() if lists.flatten().null_count else lists.flatten().to_numpy().tolist()
                sizes = pc.list_value_length(lists).to_pylist()
                ends = np.cumsum([n or 0 for n in sizes]).tolist()
                texts = [None if n is None else decode(known, ids[end - n : end]) for n, end in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*carried, out_col])

    return mapped(frame, run, T.StructType([*frame.schema.fields, T.StructField(out_col, T.StringType())]))
