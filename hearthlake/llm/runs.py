"""Periodic runs of words: a harmonic grid of extension queries over a suffix array, a reversed one and range minima."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import mapped
from hearthlake.llm.words import pieces_of, views

#: Words that a run needs, and times that its period must stand in it.
LEAST, TIMES = 6, 4
#: Values of a common prefix array whose minimum is kept; parts of blocks are read directly.
SPAN = 32
#: Words of a text whose grid is made once for all texts, and grid points looked at together.
USUAL, CHUNK = 1 << 14, 1 << 20


class Minima:
    """Range minima: a sparse table over the minima of blocks, and the values themselves at the two ends."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // SPAN)
        self.values = np.append(values, np.full(n * SPAN - len(values) + 1, np.iinfo(values.dtype).max, values.dtype))
        self.levels = [self.values[: n * SPAN].reshape(n, SPAN).min(1)]
        while 2 << (len(self.levels) - 1) <= n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, past: np.ndarray) -> np.ndarray:
        """The minimum of values[low:past] for each pair of places; low < past."""
        first, last = -(-low // SPAN), past // SPAN
        found = np.minimum(self.ends(low, np.minimum(first * SPAN, past)), self.ends(np.maximum(last * SPAN, low), past))
        blocks = last - first
        for level in np.unique(np.frexp(blocks[blocks > 0])[1] - 1):
            some = np.flatnonzero((blocks > 0) & (np.frexp(blocks)[1] - 1 == level))
            table = self.levels[level]
            found[some] = np.minimum(found[some], np.minimum(table[first[some]], table[last[some] - (1 << level)]))
        return found

    def ends(self, low: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Minima of ranges shorter than a block; the largest number for empty ones."""
        pairs = np.stack((low, past), 1).ravel()
        return np.where(low < past, np.minimum.reduceat(self.values, pairs)[::2], self.values[-1])


class Extensions:
    """The suffix array of a sequence of small numbers, and how far any two suffixes of it agree.

    Suffixes are sorted by prefixes of doubling length. Where neighbours part at a step, their common
    prefix is the length before it and that of the suffixes behind, which earlier steps have settled.
    """

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        far = np.iinfo(np.int64).max
        order = np.argsort(ids, kind="stable")
        fresh = np.append(True, ids[order][1:] != ids[order][:-1])
        self.common = np.where(fresh, 0, far)
        self.settle(order)
        length = 1
        while not fresh.all():
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            key = rank * (n + 1)
            key[:-length] += rank[length:]
            order = np.argsort(key, kind="stable")
            sorted_keys = key[order]
            parted = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
            new = np.flatnonzero(parted & ~fresh)
            behind = self.agree(order[new - 1] + length, order[new] + length)
            self.common[new] = length + behind
            fresh = parted
            self.settle(order)
            length *= 2

    def settle(self, order: np.ndarray) -> None:
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)
        self.minima = Minima(self.common)

    def agree(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many numbers from each place of one on equal those from the place of other on; the places differ, and may be past the end."""
        found = np.zeros(len(one), np.int64)
        inside = np.flatnonzero((one < self.n) & (other < self.n))
        a, b = self.place[one[inside]], self.place[other[inside]]
        found[inside] = self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b) + 1)
        return found


def grid(n: int, low: int = 1, past: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Periods from low to before past, and for each the even multiples of it that a run of TIMES periods in n words can have first inside."""
    periods = np.arange(low, n // TIMES + 1 if past is None else past)
    # The first even multiple inside a run lies before its third period, so two more periods follow.
    several = np.maximum((n - 1) // periods - 2, 0) // 2 + 1
    every = np.repeat(periods, several)
    return every, 2 * every * (np.arange(len(every)) - np.repeat(np.cumsum(several) - several, several))


class Grid:
    """The grid points of texts of any length; those of texts up to USUAL words are made once and sorted by the length that needs them."""

    def __init__(self, usual: int = USUAL, chunk: int = CHUNK):
        self.usual, self.chunk = usual, chunk
        periods, places = grid(usual)
        needs = np.maximum(TIMES * periods, places + 2 * periods + 1)
        order = np.argsort(needs, kind="stable")
        self.periods, self.places, self.needs = periods[order].astype(np.int32), places[order].astype(np.int32), needs[order]

    def points(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n <= self.usual:
            m = np.searchsorted(self.needs, n, side="right")
            yield self.periods[:m], self.places[:m]
            return
        low = 1
        while low <= n // TIMES:
            past = low + max(1, self.chunk * 2 * low // n)
            periods, places = grid(n, low, min(past, n // TIMES + 1))
            yield from ((periods[k : k + self.chunk], places[k : k + self.chunk]) for k in range(0, len(periods), self.chunk))
            low = past


class Run(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


NONE = np.empty(0, np.int64)


def runs_of(ids: np.ndarray, points: Grid) -> Run:
    """The maximal stretches of words with smallest period q that have LEAST words and TIMES * q or more, by start and period.

    A run of TIMES periods has an even multiple x of its period p inside, with two whole periods behind
    it: there words p apart are equal. How far they are equal forward and backward of x gives the run.
    Grid points where three such pairs of words already differ are not asked.
    """
    n, found, ahead, back = len(ids), [], None, None
    for p, x in points.points(n):
        keep = np.flatnonzero(ids[x] == ids[x + p])
        p, x = p[keep], x[keep]
        keep = np.flatnonzero((ids[x + p] == ids[x + 2 * p]) & (ids[x + p // 2] == ids[x + p // 2 + p]))
        if not len(keep):
            continue
        p, x = p[keep].astype(np.int64), x[keep].astype(np.int64)
        if ahead is None:
            ahead, back = Extensions(ids), Extensions(ids[::-1])
        forward, backward = ahead.agree(x, x + p), back.agree(n - x, n - x - p)
        length = backward + p + forward
        keep = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack((x - backward, length, p))[:, keep])
    if not found:
        return Run(NONE, NONE, NONE)
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # A stretch found with several periods has the smallest one; two runs of one start differ in length.
    own = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return Run(start[order], length[order], period[order])


def best_of(runs: Run) -> int:
    """The run of the greatest length / period, compared exactly; of equal ones the first."""
    best = 0
    for k in range(1, len(runs.start)):
        if int(runs.length[k]) * int(runs.period[best]) > int(runs.length[best]) * int(runs.period[k]):
            best = k
    return best


def repeated_from(n: int, number: int) -> tuple[int, int] | None:
    """Where a text of n words starts to repeat, and its period, for every tenth number; see looped()."""
    g = number // 10
    if number % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def looped(ids: np.ndarray, number: int) -> np.ndarray:
    """The words of a text, of which every tenth number's repeats some words from a place that the number decides up to its end."""
    at = repeated_from(len(ids), number)
    if at is None:
        return ids
    a, p = at
    return np.concatenate((ids[:a], np.resize(ids[a : a + p], len(ids) - a)))


def read_words(text: memoryview) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the different words."""
    known: dict[bytes, int] = {}
    parts = []
    for piece in pieces_of(text):
        words = piece.split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), list(known)


def digest_of(ids: np.ndarray, words: list[bytes], step: int = 1 << 16) -> str:
    """The hex SHA-256 of the words joined by one space."""
    digest = hashlib.sha256()
    for at in range(0, len(ids), step):
        digest.update(b" " * bool(at) + b" ".join([words[i] for i in ids[at : at + step].tolist()]))
    return digest.hexdigest()


def collapsed(runs: Run, n: int) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs.start + runs.period, 1)
    np.add.at(depth, runs.start + runs.length, -1)
    return np.cumsum(depth)[:-1] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row of docs; no row is moved.

    Words are cut at ASCII white space and numbered from 0. start to exponent_milli are of the run with the
    greatest length / period and null without runs. runs_sha256 is over the lines `start,length,period` of all
    runs, collapsed_sha256 over the words that stay when each run keeps its first period, joined by spaces.
    Null, empty and wordless texts have no run and the digests of nothing. With loop, the texts of every tenth
    CRC-32 of the identifier repeat themselves first (see looped; a null identifier counts as ''). Repeated rows
    each get their row; an empty table gives none; columns other than the two named are not read.
    """
    fields = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]

    def row(text: memoryview, number: int | None, points: Grid) -> tuple:
        ids, words = read_words(text)
        if number is not None:
            ids = looped(ids, number)
        runs = runs_of(ids, points)
        n = len(runs.start)
        if not n:
            return 0, None, None, None, None, hashlib.sha256().hexdigest(), digest_of(ids, words)
        lines = hashlib.sha256()
        for a, b, c in zip(*(x.tolist() for x in runs), strict=True):
            lines.update(b"%d,%d,%d\n" % (a, b, c))
        start, length, period = (int(x[best_of(runs)]) for x in runs)
        return n, start, length, period, 1000 * length // period, lines.hexdigest(), digest_of(ids[collapsed(runs, len(ids))], words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = Grid()
        for batch in batches:
            numbers = [zlib.crc32(str("" if i is None else i).encode()) if loop else None for i in batch.column(0).to_pylist()]
            found = [row(text, number, points) for text, number in zip(views(batch.column(1)), numbers, strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True))], ["doc_id", *(name for name, _ in fields)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in fields)
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {schema}")
