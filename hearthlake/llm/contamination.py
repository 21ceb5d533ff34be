"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hearthlake.llm.shared import Scratch, mapped, received, sent, without

#: Errors allowed for each character of a test item.
ERROR_RATE = 0.08
#: Bytes of test items that one pass over the documents carries, some three bytes of memory for each; a larger benchmark takes several passes.
BLOCK = 32 << 20
#: Characters from which a piece is found by hash, places of the table over them at most, characters of a text hashed at a time, items whose tables a task keeps.
GRAM, MOST_PLACES, WINDOW, PATTERNS = 6, 1 << 24, 1 << 17, 10_000
BASE = 0x9E3779B97F4A7C15
INVERSE, SALT = pow(BASE, -1, 1 << 64), np.uint64(0x51_7CC1_B727_220A)


def normalised(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of nearly equal length: that many errors leave at least one piece whole."""
    n = budget + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def best_match(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any part of text, and where the first such part ends.

    Myers' bit-parallel scan: one word of `length` bits holds a whole column of the distance matrix.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        across = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | (full & ~(across | plus))) & full
        down = plus & across & full
        if score < best:
            best, end = score, i + 1
    return best, end


class PieceTable:
    """Pieces of GRAM characters or more by the hash of their text, in arrays: some 20 bytes for each.

    A table over the hashes of their first characters, as many as the shortest one has, says where in a text a piece may begin; there the hashes of
    all lengths that pieces have are looked up. Hits are compared as text by the caller.
    """

    def __init__(self, found: list[tuple[int, int, int]], items: list[str]):
        """found: (item, begin, end) of every piece."""
        self.begins = np.zeros(1 << 16, bool)
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(self.begins) < min(MOST_PLACES, 16 * len(found)):
            self.begins = np.zeros(2 * len(self.begins), bool)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, begin, end in found:
            by_length.setdefault(end - begin, []).append((k, begin))
        self.gram = min(by_length)
        for length, places in sorted(by_length.items()):
            codes = np.frombuffer("".join(items[k][begin : begin + length] for k, begin in places).encode("utf-32-le", "surrogatepass"), np.uint32)
            sums = prefix_sums(codes)
            starts = np.arange(len(places)) * length
            self.begins[self.places(gram_hashes(sums, starts, self.gram))] = True
            keys = gram_hashes(sums, starts, length)
            order = np.argsort(keys, kind="stable")
            owner, offset = np.array(places, np.int32).T
            self.tables.append((length, keys[order], owner[order], offset[order]))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.begins) - 1)).view(np.int64)

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, offset of the piece in it, where the piece stands in text), in the order of places for each length."""
        gram = self.gram
        for low in range(0, max(1, len(text) - gram + 1), WINDOW):
            # Windows overlap by the longest piece, so that each piece lies in the one that it begins in.
            part = text[low : low + WINDOW + self.tables[-1][0]]
            sums = prefix_sums(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
            n = max(0, min(WINDOW, len(part) - gram + 1))
            starts = np.flatnonzero(self.begins[self.places(gram_hashes(sums, slice(0, n), gram, slice(gram, gram + n)))])
            if not len(starts):
                continue
            for length, keys, owner, offset in self.tables:
                some = starts[: np.searchsorted(starts, len(part) - length, side="right")]
                wanted = gram_hashes(sums, some, length)
                first, past = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
                for i in np.flatnonzero(past > first).tolist():
                    for j in range(first[i], past[i]):
                        yield int(owner[j]), int(offset[j]), low + int(some[i])


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of mixed character codes times powers of BASE, from 0 on."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + SALT) * powers(BASE, len(codes)), out=out[1:])
    return out


def gram_hashes(sums: np.ndarray, starts: np.ndarray | slice, length: int, ends: slice | None = None) -> np.ndarray:
    """The hash of `length` characters from each start, whatever stands around them."""
    h = (sums[starts + length if ends is None else ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return h ^ (h >> np.uint64(37))


def powers(base: int, n: int, tables: dict = {}) -> np.ndarray:  # noqa: B006
    """The first n powers of base; the longest table so far is kept."""
    if len(tables.get(base, ())) < n:
        tables[base] = np.cumprod(np.array([1] + [base] * (max(n, 4096) - 1), np.uint64))
    return tables[base][:n]


class Matcher:
    """Test items of one block. Long pieces are found by hash, the few short ones by an automaton that each task builds."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(item, text, int(rate * len(text))) for item, text in items if text]
        found = [(k, begin, end) for k, (_, text, budget) in enumerate(self.items) for begin, end in pieces(len(text), budget)]
        long = [p for p in found if p[2] - p[1] >= GRAM]
        self.short = [p for p in found if p[2] - p[1] < GRAM]
        self.table = PieceTable(long, [text for _, text, _ in self.items]) if long else None
        self.automaton = None
        self.bits: dict[int, dict[str, int]] = {}

    def build(self) -> None:
        """The automaton over the short pieces."""
        found: dict[str, list[tuple[int, int]]] = {}
        for k, begin, end in self.short:
            found.setdefault(self.items[k][1][begin:end], []).append((k, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, where it would begin) for every piece that stands in text."""
        if self.table is not None:
            for k, offset, at in self.table.hits(text):
                yield k, at - offset
        if self.short:
            if self.automaton is None:
                self.build()
            for last, (length, places) in self.automaton.iter(text):
                for k, offset in places:
                    yield k, last + 1 - length - offset

    def pattern(self, k: int) -> dict[str, int]:
        if k not in self.bits:
            if len(self.bits) >= PATTERNS:
                self.bits.clear()
            table: dict[str, int] = {}
            for i, c in enumerate(self.items[k][1]):
                table[c] = table.get(c, 0) | 1 << i
            self.bits[k] = table
        return self.bits[k]

    def matches(self, text: str) -> list[tuple[object, int, int]]:
        """(item, distance, end) of every item found within its budget in an already normalised text: its best place, the first of equal ones."""
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        for k, start in self.hits(text):
            _, item, budget = self.items[k]
            if start >= 0 and text.startswith(item, start):
                best[k] = min(best.get(k, (1, 0)), (0, start + len(item)))
                continue
            # One window reaches the budget to both sides, so a hit on the same diagonal needs no other.
            if best.get(k, (1,))[0] == 0 or seen.get(k) == start:
                continue
            seen[k] = start
            low = max(0, start - budget)
            distance, end = best_match(self.pattern(k), len(item), text[low : max(0, start) + len(item) + budget])
            if distance <= budget:
                best[k] = min(best.get(k, (budget + 1, 0)), (distance, low + end))
        return [(self.items[k][0], d, e) for k, (d, e) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end_char: every document that holds a test item within rate errors a character.

    Both sides are lower-cased and their white space collapsed; end_char counts in that text. An item
    too short for an error must occur as it is; null and empty items match nothing, null and empty
    documents hold nothing. Items are taken in blocks of at most about BLOCK bytes, each block
    against all documents in one scan without a shuffle. Repeated items give a row each, repeated
    documents too; identifiers of items may be of any plain type; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK))
    kind, item_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(items.schema["item_id"].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        matcher = sent(spark, Matcher([(r["item_id"], normalised(r["text"])) for r in part.collect()], rate))

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            block_matcher = received(matcher)
            for batch in batches:
                at, item, distance, end = [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    for k, d, e in block_matcher.matches(normalised(text.as_py())):
                        at.append(i), item.append(k), distance.append(d), end.append(e)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), pa.array(distance, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "end_char"])

        leaks = mapped(rows, run, f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, distance long, end_char long")
        found = leaks if found is None else found.unionByName(leaks)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, whose identifier has no leak; rows without an identifier stay."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, Scratch(docs.sparkSession, "leaks").keep(leaks, "ids", docs.count()), id_col)
