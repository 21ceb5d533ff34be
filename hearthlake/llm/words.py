"""Words of whole texts, read a block at a time, so that a long text never becomes one list of Python objects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of every row of a string column, not copied; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    held = column.buffers()[2]
    data = memoryview(held if held is not None else b"")
    return (data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def pieces_of(text: memoryview, block: int = BLOCK) -> Iterator[bytes]:
    """The text in pieces of about `block` bytes, cut before white space; one piece where a word is longer."""
    at = 0
    while at < len(text):
        past = min(at + block, len(text))
        if past < len(text):
            found = SPACE.search(text, past)
            past = found.start() if found else len(text)
        yield bytes(text[at:past])
        at = past


def shingle_hashes(text: memoryview | bytes, width: int, seed: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The XXH64 of a text's word shingles (A-Z lower-cased, space-joined) in order, in several arrays.

    A text of fewer words than a shingle is one shingle, one without words none.
    """
    held: list[bytes] = []
    some = False
    for piece in pieces_of(text, block):
        words = held + piece.lower().split()
        if len(words) >= width:
            some = True
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - width + 1
            shingles = [line[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", n)
        held = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], "<u8")


def shingle_set(text: memoryview | bytes, width: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    parts = [np.unique(part) for part in shingle_hashes(text, width, seed)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, "<u8")
