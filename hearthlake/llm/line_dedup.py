"""Line dedup by content-defined chunks: rolling hashes over line hashes bound them, bytes confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, bitmap_of, holds, joined_by_key, key_filter, mapped, parted, received, sent, unused

#: Bytes from which a line is a paragraph and is split, and bytes that a chunk needs if it doesn't hold two whole lines.
PARAGRAPH = CHUNK = 160
#: A paragraph is split into sentences, and those of so many bytes after one in so many words, chosen by their last bytes.
SENTENCE, SPACING = 64, 8
#: A block of repeated pairs ends where a rolling hash is 0 modulo this: equal passages have equal blocks inside, and blocks are compared first.
BOUNDARY = 8
#: Bytes hashed at a time, and bytes of texts taken together.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64
# Marks that end a sentence, and what may close it.
MARKS, CLOSING = b".!?|#$%&*+=~^", b"\"')]"


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bytes_of(head: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the bytes of the group that it belongs to; head marks the first word of each group."""
    first = np.flatnonzero(head)
    past = np.append(first[1:], len(head))
    return np.repeat(end[past - 1] - begin[first], past - first)


class Units(NamedTuple):
    """The lines and parts of paragraphs of several texts in a row."""

    text: np.ndarray  #: which text
    begin: np.ndarray  #: where the unit begins in the joint bytes
    end: np.ndarray  #: where its last visible byte ends
    whole: np.ndarray  #: 1 for a whole line
    rolling: np.ndarray  #: rolling hash over this unit's hash and the next one's
    paired: np.ndarray  #: whether a unit of the same text follows


class Cutter:
    """Texts to units; the tables of a polynomial hash are made in each task."""

    def __init__(self, bits: int = 64) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.values = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
        self.inverse = pow(BASE, -1, WORD)
        self.up, self.down = (np.cumprod(np.array([1] + [b] * (BLOCK - 1), np.uint64)) for b in (BASE, self.inverse))
        self.marks, self.closing = byte_set(MARKS), byte_set(CLOSING)

    def prefixes(self, data: np.ndarray, *several: np.ndarray) -> list[np.ndarray]:
        """For each array of ascending places the hash of the bytes before every place."""
        out, carry = [np.zeros(len(places), np.uint64) for places in several], 0
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            sums = np.cumsum(self.values[part] * self.up[: len(part)])
            factor = pow(BASE, at, WORD)
            for places, found in zip(several, out, strict=True):
                low, high = np.searchsorted(places, [at, at + len(part)], side="right")
                found[low:high] = sums[places[low:high] - at - 1] * np.uint64(factor) + np.uint64(carry)
            carry = (carry + factor * int(sums[-1])) % WORD
        return out

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the bytes from each begin to its end, wherever they stand."""
        blocks = np.array([pow(self.inverse, int(k) * BLOCK, WORD) for k in range(len(data) // BLOCK + 1)], np.uint64)
        before, up_to = self.prefixes(data, begin, end)
        return mixed((up_to - before) * self.down[begin % BLOCK] * blocks[begin // BLOCK])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of texts begin and end: at white space, at the ends of texts and after marks of unspaced scripts."""
        ink = data > 32
        cut = ~ink
        starts = np.ones(len(data) + 1, bool)
        starts[1:] = cut
        starts[offsets] = True
        wide = (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] >= 0x81) & (data[2:] <= 0x82)
        wide |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & np.isin(data[2:], (0x81, 0x8C, 0x9B, 0x9F))
        starts[np.flatnonzero(wide) + 3] = True
        begin = np.flatnonzero(ink & starts[:-1])
        ends = np.append(cut, True)
        ends |= starts
        end = np.flatnonzero(ends[1:] & ink) + 1
        return begin, end

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        """The units of the texts between offsets of data.

        A line is a unit, without the white space around it; lines without visible bytes are none. A line
        of PARAGRAPH bytes or more is split after every mark that ends a word, and a sentence of SENTENCE
        bytes or more after the words that their last four bytes choose. So units inside a passage follow
        from its own text, wherever it stands.
        """
        begin, end = self.words(data, offsets)
        if not len(begin):
            none = np.empty(0, np.int64)
            return Units(none, none, none, none, none.view(np.uint64), none.astype(bool))
        line = np.searchsorted(np.flatnonzero(data == 10), begin)
        text = np.searchsorted(offsets, begin, side="right") - 1
        fresh = np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1]))
        long = bytes_of(fresh, begin, end) >= PARAGRAPH
        last = data[end - 1]
        marked = self.marks[last] | self.closing[last] & self.marks[data[np.maximum(end - 2, 0)]] & (end - 2 >= begin)
        marked |= (last >= 0x81) & (np.append(begin[1:], -1) == end)
        head = fresh | long & np.append(True, marked[:-1])
        # Of the long sentences of paragraphs, every word that its last bytes choose ends a unit, too.
        wordy = np.flatnonzero(long & (bytes_of(head, begin, end) >= SENTENCE))
        tail = np.zeros(len(wordy), np.uint64)
        for k in range(1, 5):
            at = end[wordy] - k
            tail = (tail << np.uint64(8)) | np.where(at >= begin[wordy], data[np.maximum(at, 0)], 0).astype(np.uint64)
        chosen = wordy[((tail * np.uint64(BASE)) >> np.uint64(40)) % np.uint64(SPACING) == 0] + 1
        head[chosen[chosen < len(head)]] = True
        at = np.flatnonzero(head)
        to = np.append(at[1:], len(begin)) - 1
        b, e, owner = begin[at], end[to], text[at]
        h = self.hashes(data, b, e)
        paired = np.append(owner[1:] == owner[:-1], False)
        rolling = mixed(h * np.uint64(BASE) + np.append(h[1:], np.uint64(0)))
        return Units(owner, b, e, (~long[at]).astype(np.int64), rolling & self.mask, paired)


def long_enough(units: Units, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last pair of each chunk: a longest run of pairs that stand earlier, too, over two whole lines or CHUNK bytes."""
    edges = np.diff(np.concatenate(([0], (earlier & units.paired).view(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    lines = np.concatenate(([0], np.cumsum(units.whole)))
    enough = (units.end[last + 1] - units.begin[first] >= CHUNK) | (lines[last + 2] - lines[first] >= 2)
    return first[enough], last[enough]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, joint bytes, offsets) of texts in a row, of about BLOCK bytes or one text; null counts as empty."""
    data, ends = joint(column)
    at = 0
    while at < len(column):
        past = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
        yield at, data[ends[at] : ends[past]], ends[at : past + 1] - ends[at]
        at = past


def joint(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8), offsets


def pair_counts(docs: DataFrame, bits: int) -> DataFrame:
    """rolling, n: the rolling hashes of the texts and how often they stand there, added up for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(bits)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                units = cutter.units(data, offsets)
                values, counts = np.unique(units.rolling[units.paired], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["rolling", "n"])

    return mapped(docs.select("text"), run, "rolling long, n long")


def blocks_that_may_recur(docs: DataFrame, common: Broadcast, bits: int) -> DataFrame:
    """doc_id, mark, place, rolling, body, begins, ends: the pairs that the filter lets through, in blocks.

    Runs of such pairs are cut where a rolling hash is 0 modulo BOUNDARY. body has the bytes of a block of n
    pairs from its first unit to its last one, begins and ends say where its n + 1 units stand in it, place
    is its first pair's number in the text, rolling the hash of that pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, bitmap = Cutter(bits), received(common)
        for batch in batches:
            for row, data, offsets in slices(batch.column(2)):
                units = cutter.units(data, offsets)
                found = units.paired & holds(bitmap, units.rolling)
                head = found & (~np.append(False, found[:-1]) | (units.rolling % np.uint64(BOUNDARY) == 0))
                at, pairs = np.flatnonzero(found), np.flatnonzero(head[found])
                first, n = at[pairs], np.diff(np.append(pairs, len(at)))
                raw, owner = data.tobytes(), units.text[first]
                bodies = [raw[a:b] for a, b in zip(units.begin[first].tolist(), units.end[first + n].tolist(), strict=True)]
                past = np.cumsum(n + 1)
                inside = np.repeat(first - past + n + 1, n + 1) + np.arange(past[-1] if len(past) else 0)
                bounds = pa.array(np.append(0, past), pa.int32())
                shift = np.repeat(units.begin[first], n + 1)
                begins, ends = (pa.ListArray.from_arrays(bounds, pa.array(x[inside] - shift, pa.int32())) for x in (units.begin, units.end))
                rows, place = pa.array(row + owner), first - np.searchsorted(units.text, owner)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place, pa.int32()), pa.array(units.rolling[first].view(np.int64)), pa.array(bodies, pa.binary()), begins, ends]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "place", "rolling", "body", "begins", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "mark", "text"), run, f"doc_id {kind}, mark long, place int, rolling long, body binary, begins array<int>, ends array<int>")


#: What becomes of a pair: it is the first one and stays, goes, or goes and overlaps the first one, so that only its second unit does.
STAYS, GOES, SECOND_GOES = 0, 1, 2
OWN, KEY = ["doc_id", "mark", "place"], ["rolling", "other"]


def entry(n, fate):
    """n pairs from place on, and their fate, as one number."""
    return (F.shiftleft(F.col("place").cast("long"), 33) + F.shiftleft(n.cast("long"), 2) + fate).alias("entry")


def repeated_pairs(docs: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """doc_id, mark, entries (the pairs that stand at an earlier place, too), for the rows of docs (doc_id, mark, text) that have any.

    Rolling hashes that occur more than once make a bounded filter. The blocks of pairs behind it are
    grouped by their bytes; the pairs of all but the first of equal blocks go. The pairs of the first
    ones, and of blocks that are alone, are grouped by their bytes, and all but the first occurrence
    (smallest doc_id, mark, place) go. Bytes are compared in these groupings; the joins after them go by
    128 bits of hashes.
    """
    counts = pair_counts(docs, bits).groupBy("rolling").agg(F.sum("n").alias("n"))
    common = scratch.keep(counts.where("n > 1").select("rolling"), "common")
    found = blocks_that_may_recur(docs, sent(docs.sparkSession, bitmap_of(common, "rolling")), bits)
    # Plain numbers as first keys: sorts by them compare numbers, and bytes only where those are equal.
    found = scratch.keep(found.withColumn("other", F.xxhash64("body", "ends")), "found", compression="zstd")
    first = F.min(F.struct(*OWN)).alias("first")
    several = F.size("ends") > 2
    blocks = found.where(several).groupBy("rolling", "other", "body", "begins", "ends").agg(first, F.count("*").alias("n"))
    blocks = scratch.keep(blocks, "blocks", compression="zstd")
    again = joined_by_key(found.where(several).select(*OWN, *KEY, F.size("ends").alias("units")), blocks.where("n > 1").select(*KEY, "first", "n"), KEY, "n", scratch, way="shuffle_hash")
    later = again.where(F.struct(*OWN) != F.col("first")).select("doc_id", "mark", entry(F.col("units") - 1, F.lit(GOES)))

    each = blocks.select("first.doc_id", "first.mark", F.col("first.place").alias("start"), "n", "body", "begins", "ends", F.explode(F.sequence(F.lit(0), F.size("ends") - 2)).alias("k"))
    begin, end = F.element_at("begins", F.col("k") + 1), F.element_at("ends", F.col("k") + 2)
    each = each.select("doc_id", "mark", (F.col("start") + F.col("k")).alias("place"), "n", F.substring("body", begin + 1, end - begin).alias("body"))
    pairs = each.unionByName(found.where(~several).select(*OWN, F.lit(1).cast("long").alias("n"), "body"))
    pairs = scratch.keep(pairs.withColumn("rolling", F.xxhash64("body")).withColumn("other", F.xxhash64(F.lit(1), "body")), "pairs", compression="zstd")
    repeated = pairs.groupBy(*KEY, "body").agg(first, F.count("*").alias("rows"), F.sum("n").alias("n")).where("n > 1").select(*KEY, "first", "rows")
    repeated = scratch.keep(repeated, "repeated")
    joined = joined_by_key(pairs.select(*OWN, *KEY), repeated, KEY, "rows", scratch, way="shuffle_hash")
    beside = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.mark") == F.col("mark")) & (F.col("first.place") == F.col("place") - 1)
    fate = F.when(F.struct(*OWN) == F.col("first"), STAYS).when(beside, SECOND_GOES).otherwise(GOES)
    gone = joined.select("doc_id", "mark", entry(F.lit(1), fate), fate.alias("fate")).where(F.col("fate") != STAYS).drop("fate")
    drop = scratch.keep(gone.unionByName(later).groupBy("doc_id", "mark").agg(F.collect_set("entry").alias("entries")), "drop")
    scratch.only("drop")
    return drop


def fates_of(units: Units, entries: pa.ListArray) -> np.ndarray:
    """The fate of every pair of units; the i-th list of entries is about the i-th text."""
    fates = np.full(len(units.begin), STAYS, np.int64)
    flat = entries.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(entries.offsets.to_numpy())
    first = np.repeat(np.searchsorted(units.text, np.arange(len(entries))), sizes) + (flat >> 33)
    n = (flat >> 2) & ((1 << 31) - 1)
    inside = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    fates[inside] = np.repeat(flat & 3, n)
    return fates


def gone_units(units: Units, fates: np.ndarray) -> np.ndarray:
    """Which units go: those of a pair that goes, inside a chunk that is long enough."""
    first, last = long_enough(units, fates != STAYS)
    inside = np.zeros(len(fates) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    gone = inside & (fates == GOES)
    gone[1:] |= inside[:-1]
    return gone


def cut_texts(cutter: Cutter, texts: pa.Array, entries: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts without what goes, and the number of chunks cut from each; texts without entries stay as they are.

    From a unit that goes everything goes up to the next one that stays; what stood before a removed end
    keeps no white space.
    """
    hit = np.flatnonzero(np.asarray(entries.is_valid()))
    out, removed = [None] * len(hit), np.zeros(len(texts), np.int64)
    some, lists = texts.take(pa.array(hit)), entries.take(pa.array(hit))
    for row, data, offsets in slices(some):
        n = len(offsets) - 1
        units = cutter.units(data, offsets)
        gone = gone_units(units, fates_of(units, lists.slice(row, n)))
        # A span ends with the next unit of its text that stays, or with the text.
        edge = np.diff(np.concatenate(([False], gone)).view(np.int8)) == 1
        begins = np.flatnonzero(edge | gone & np.append(True, units.text[1:] != units.text[:-1]))
        stays = np.append(np.flatnonzero(~gone), len(gone))
        after = stays[np.searchsorted(stays, begins)]
        until = np.append(units.begin, len(data))[after]
        until = np.minimum(until, offsets[units.text[begins] + 1])
        raw, spans = data.tobytes(), {}
        for text, begin, end in zip(units.text[begins].tolist(), units.begin[begins].tolist(), until.tolist(), strict=True):
            spans.setdefault(text, []).append((begin, end))
        for text, cut in spans.items():
            at, kept = int(offsets[text]), []
            for begin, end in cut:
                kept.append(raw[at:begin])
                at = end
            left = b"".join([*kept, raw[at : offsets[text + 1]]])
            left = left.rstrip(b" \t\r\n") if at == offsets[text + 1] else left
            out[row + text], removed[hit[row + text]] = left, len(cut)
    changed = np.zeros(len(texts), bool)
    changed[hit] = [left is not None for left in out]
    cut = pa.array((left for left in out if left is not None), pa.binary()).cast(pa.string())
    return pc.replace_with_mask(texts, pa.array(changed), cut), pa.array(removed)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, bits: int = 64) -> DataFrame:
    """docs, all columns, with repeated chunks cut out of the texts; with report also removed (chunks) and removed_chars.

    A rolling hash is taken over the hashes of every two lines in a row. A chunk is a longest run of
    lines all of whose rolling hashes stand at an earlier place of the table, too: its bounds follow from
    the lines inside it and move with them, wherever a passage is put. A chunk needs two whole lines or CHUNK bytes; lines of
    PARAGRAPH bytes or more are split and cut likewise, so that a passage inside a paragraph is found.
    Every two lines in a row are compared byte for byte with those of equal hash before they go, and
    the first occurrence (smallest doc_id, then place) stays. So every line that goes still stands
    at an earlier place.

    Rows are told apart by identifier and text: rows that share an identifier with different texts
    are different rows, repeated rows of one text are one and keep what its first occurrence keeps.
    Null texts stay null and empty ones empty; a text that repeats earlier ones whole becomes empty.
    Rows without an identifier pass unchanged and are not compared. An empty table gives no rows.
    Columns of any name pass through; report columns take underscores where their names are used.
    Of the rolling hashes `bits` bits are used; with few of them nearly all clash, and the result is the same.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    mark, entries = unused("_mark", docs.columns), unused("_entries", docs.columns)
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(mark).alias("mark"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    drop = repeated_pairs(rows, scratch, bits).withColumnsRenamed({"doc_id": id_col, "mark": mark, "entries": entries})
    # Only documents that lose a chunk are shuffled; the others stay where they are.
    outside, inside = parted(marked, mark, *key_filter(drop, mark))
    joined = outside.withColumn(entries, F.lit(None).cast("array<long>")).unionByName(inside.join(drop.hint("merge"), [id_col, mark], "left").select(*marked.columns, entries)).drop(mark)
    at = docs.columns.index(text_col)
    names = list(docs.columns)
    if report:
        names += [unused(n, docs.columns) for n in ("removed", "removed_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            texts, found = batch.column(at), batch.column(len(batch.columns) - 1)
            columns = list(batch.columns[:-1])
            if report or found.null_count < len(found):
                columns[at], removed = cut_texts(cutter, texts, found)
                if report:
                    before, after = (pc.fill_null(pc.utf8_length(x), 0).cast(pa.int64()) for x in (texts, columns[at]))
                    columns += [removed, pc.subtract(before, after)]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(joined, run, fields + "".join(f", `{n}` long" for n in names[len(docs.columns) :]))
