"""Jaccard join of shingle sets as a T-occurrence search: short inverted lists are merged, long ones probed (DivideSkip)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.components import components
from hearthlake.llm.shared import Scratch, bitmap_of, holds, joined_by_key, key_filter, mapped, parted, received, sent, without
from hearthlake.llm.words import shingle_set, views

WIDTH, PERCENT, SEED = 4, 85, 42
#: Members of an inverted list up to which it is short and merged; longer lists are put behind the others and met by pivots.
SHORT = 32
#: Rounds in which sets are ordered anew behind long lists that came up; what is still long then is met by pivots.
ROUNDS = 3
#: Times the length of its prefix that a set is read ahead at most to find long lists.
AHEAD = 8
#: Members of a long list that are drawn as pivots in each round, and parts that the pairs of a pivot are dealt to.
DRAWN, SALTS = (8, 64), 16
#: Ratio of the bounds of a class of sizes.
STEP = 1.02


def occurrences(n: Column, m: Column, percent: int) -> Column:
    """T: how many shingles sets of these sizes must share."""
    return F.ceil((n + m) * (percent / (100.0 + percent)) - 1e-6)


def own_occurrences(n, percent: int):
    """What a set of n must share with any partner, whatever its size."""
    return -(-percent * n // 100)


def rest_of(n: Column, percent: int) -> Column:
    """Shingles of a set of n behind its prefix: its long lists, never merged."""
    return F.ceil(n * (percent / 100.0) - 1e-6) - 1


def may_link(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def prefix_of(shingles: np.ndarray, late: np.ndarray | None, percent: int, times: int = 1) -> np.ndarray:
    """The first shingles of an ascending set in the common order (those outside the filter `late` first), so many that any partner has one of them in its own prefix; or so many times as many."""
    if late is not None:
        behind = holds(late, shingles)
        shingles = np.concatenate((shingles[~behind], shingles[behind]))
    n = len(shingles)
    return shingles[: times * (n - own_occurrences(n, percent) + 1)] if n else shingles


def start_of(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of an ascending set: its prefix in the order of the hashes and half as many more, from which most later prefixes can be told."""
    n = len(shingles)
    return shingles[: 3 * (n - own_occurrences(n, percent) + 1) // 2 + 1] if n else shingles


def key_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of unsigned hashes as one list column of signed ones."""
    flat = np.concatenate(parts) if parts else np.empty(0, "<u8")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view("<i8")))


def marked_sets(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, key (digest of the set), n (its size), start for rows (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, starts = [], [], []
            for text in views(batch.column(2)):
                found = shingle_set(text, width, SEED)
                keys.append(key_of(found)), sizes.append(len(found)), starts.append(start_of(found, percent))
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists(starts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "key", "n", "start"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, row long, key binary, n long, start array<long>")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """key and the set of shingles for texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, width, SEED) for text in views(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], pa.binary()), lists(sets)], ["key", "shingles"])

    return mapped(texts.select("text"), run, "key binary, shingles array<long>")


def prefixes_behind(texts: DataFrame, width: int, percent: int, late) -> DataFrame:
    """key, prefix behind the broadcast filter late, and ahead for texts (text): what follows the prefix, up to AHEAD times its length, where half of the first shingles are late."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = received(late)
        for batch in batches:
            keys, prefixes, ahead = [], [], []
            for text in views(batch.column(0)):
                found = shingle_set(text, width, SEED)
                first = prefix_of(found, behind, percent)
                much = 2 * np.count_nonzero(holds(behind, found[: len(first)])) >= len(first)
                keys.append(key_of(found)), prefixes.append(first), ahead.append(prefix_of(found, behind, percent, AHEAD)[len(first) :] if much else found[:0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists(prefixes), lists(ahead)], ["key", "prefix", "ahead"])

    return mapped(texts.select("text"), run, "key binary, prefix array<long>, ahead array<long>")


def prefixes_of_starts(classes: DataFrame, percent: int, late) -> DataFrame:
    """key, row, prefix behind the broadcast filter late for classes (key, row, n, start); null where the start holds too little of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = received(late)
        for batch in batches:
            starts, sizes = batch.column(3), batch.column(2).to_pylist()
            at, flat = starts.offsets.to_pylist(), starts.values.to_numpy().view("<u8")
            parts, known = [], []
            for k, n in enumerate(sizes):
                start = flat[at[k] : at[k + 1]]
                first = start[~holds(behind, start)][: n - own_occurrences(n, percent) + 1]
                known.append(len(first) == n - own_occurrences(n, percent) + 1)
                parts.append(first if known[-1] else start[:0])
            found = pc.if_else(pa.array(known), lists(parts), pa.scalar(None, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["key", "row", "prefix"])

    return mapped(classes.select("key", "row", "n", "start"), run, "key binary, row long, prefix array<long>")


def of_classes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of rows that stand for the classes of wanted (row, key); a bounded filter lets a few more through."""
    return parted(rows, "row", *key_filter(wanted, "row"))[1]


def joined_filters(one: np.ndarray | None, other: np.ndarray) -> np.ndarray:
    """A filter that lets through what either does: a smaller one is repeated, which changes nothing in what it lets through."""
    if one is None:
        return other
    most = max(len(one), len(other))
    return np.tile(one, most // len(one)) | np.tile(other, most // len(other))


def newly_late(prefixes: DataFrame, late, before) -> DataFrame:
    """The keys of prefixes with a shingle that is in the filter late but was not in the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = received(late), received(before) if before is not None else None
        for batch in batches:
            column = batch.column(1)
            flat, sizes = column.flatten().to_numpy().view("<u8"), np.diff(column.offsets.to_numpy())
            moved = holds(now, flat) & (True if then is None else ~holds(then, flat))
            hit = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[moved], minlength=len(sizes)) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["key"])

    return mapped(prefixes.select("key", "prefix"), run, "key binary")


def ordered_prefixes(classes: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int, count: int) -> DataFrame:
    """key, prefix of every class in one order for all: shingles of long lists last, else by hash.

    Any common order finds all links. Prefixes start in the order of the hashes; shingles that come up in more
    than SHORT of them go into a filter, and classes whose prefix holds one are read again behind it. What a
    filter lets through by chance is late for all classes alike.
    """
    own = (F.col("n") - rest_of(F.col("n"), percent)).cast("int")
    prefixes, written = classes.select("key", F.slice("start", F.lit(1), own).alias("prefix")), None
    fresh, late, sent_late = prefixes.withColumn("ahead", F.array().cast("array<long>")), None, None
    for turn in range(ROUNDS):
        counted = fresh.select(F.explode(F.concat("prefix", "ahead")).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
        long = scratch.keep(counted.where(F.col("c") > SHORT).select("h"), f"long-{turn}", count)
        if turn:
            scratch.drop(f"fresh-{turn - 1}")
        if long.isEmpty():
            break
        before, late = sent_late, joined_filters(late, bitmap_of(long, "h"))
        sent_late = sent(rows.sparkSession, late)
        moved = scratch.keep(newly_late(prefixes, sent_late, before), f"moved-{turn}", count)
        if moved.isEmpty():
            break
        told = scratch.keep(prefixes_of_starts(classes.join(moved, "key", "left_semi"), percent, sent_late), f"told-{turn}")
        unknown = scratch.keep(told.where("prefix IS NULL").select("key", "row"), f"again-{turn}", count)
        again = prefixes_behind(of_classes(rows, unknown), width, percent, sent_late).join(unknown.select("key"), "key", "left_semi")
        told = told.where("prefix IS NOT NULL").select("key", "prefix", F.array().cast("array<long>").alias("ahead"))
        fresh = scratch.keep(again.dropDuplicates(["key"]).unionByName(told), f"fresh-{turn}")
        prefixes = scratch.keep(without(prefixes, moved, "key").unionByName(fresh.select("key", "prefix")), f"prefixes-{turn}")
        scratch.drop(f"told-{turn}")
        if written is not None:
            scratch.drop(written)
        written = f"prefixes-{turn}"
    return prefixes


def merged_lists(queries: DataFrame) -> DataFrame:
    """a, b, n, m, shared for the candidates of queries (query, m, other: keys, size: their n), rows of one query in a row.

    Each row has one short list of a query's, in order of the keys. They are merged on a heap, which counts
    how many of them a candidate is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, held, out = None, 0, [], []

        def merged() -> None:
            for (key, size), same in groupby(heapq.merge(*held)):
                out.append((key, current, size, own, sum(1 for _ in same)))

        def taken() -> pa.RecordBatch:
            a, b, n, m, shared = zip(*out, strict=True) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, m, shared))], ["a", "b", "n", "m", "shared"])

        for batch in batches:
            keys, sizes = batch.column(2), batch.column(3)
            offsets = keys.offsets.to_pylist()
            entries = list(zip(keys.values.to_pylist(), sizes.values.to_pylist(), strict=True))
            for k, (query, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if query != current:
                    merged()
                    current, own, held = query, m, []
                held.append(entries[offsets[k] : offsets[k + 1]])
            yield taken()
        merged()
        yield taken()

    return mapped(queries.select("query", "m", "other", "size"), run, "a binary, b binary, n long, m long, shared long")


def probed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, a_set, b_set, both sets ascending) those that link: each shingle of the smaller set is looked for in the larger one by halving."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link = []
            one, other = (batch.column(k) for k in (2, 3))
            ends = [c.offsets.to_pylist() for c in (one, other)]
            flat = [c.values.to_numpy().view("<u8") for c in (one, other)]
            for k in range(batch.num_rows):
                x, y = (values[at[k] : at[k + 1]] for values, at in zip(flat, ends, strict=True))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                link.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(link, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return mapped(pairs.select("a", "b", "a_set", "b_set"), run, "a binary, b binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = 1) -> DataFrame:
    """The pairs a, b that link. Sets of b, which may stand in very many pairs, are copied for so many parts of its pairs."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("a_set"))
    other = sets.select(F.col("key").alias("b"), F.col("shingles").alias("b_set"))
    if salts > 1:
        other = other.join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        return probed(salted.join(other, ["b", "salt"]).drop("salt").join(one, "a"), percent)
    return probed(pairs.join(one, "a").join(other, "b"), percent)


def links_of_classes(classes: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int, count: int, proposed: DataFrame | None = None) -> DataFrame:
    """Links a, b between classes (key, n, start, row): their components are those of all pairs that link.

    rows (row, text) are read again for the texts of some classes. Pairs a, b proposed by another search are looked up with the candidates.
    """
    spark = classes.sparkSession
    prefixes = ordered_prefixes(classes, rows, scratch, width, percent, count)
    postings = prefixes.select("key", F.explode("prefix").alias("h"))
    sizes = scratch.keep(postings.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "sizes", count)
    # Most shingles stand in one prefix only and go before anything is shuffled.
    members = parted(postings, "h", *key_filter(sizes, "h"))[1].join(sizes, "h")
    members = scratch.keep(members, "members")
    short = F.col("c") <= SHORT
    ends = members.groupBy("key").agg(F.count_if(short).alias("s"), F.count_if(~short).alias("l"), F.collect_set(F.when(~short, F.col("h"))).alias("late"))
    ends = scratch.keep(ends.join(classes.select("key", "n", "row"), "key"), "ends", count)

    few = members.where(short).join(ends.select("key", "n"), "key").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("list"))
    queries = few.select("list", F.posexplode("list").alias("k", "own")).where("k > 0").select(F.col("own.key").alias("query"), F.col("own.n").alias("m"), F.slice("list", F.lit(1), F.col("k")).alias("before"))
    queries = queries.select("query", "m", F.transform("before", lambda x: x["key"]).alias("other"), F.transform("before", lambda x: x["n"]).alias("size"))
    counted = merged_lists(queries.repartition("query").sortWithinPartitions("query"))
    enough = needed(F.col("n"), F.col("m"), percent)
    near = counted.where(may_link(F.col("n"), F.col("m"), percent))
    # The long lists that two prefixes share were not merged; where there are any, fewer short ones are enough.
    late = [ends.select(F.col("key").alias(k), F.col("l").alias(f"{k}_l")) for k in "ab"]
    near = near.join(late[0], "a").join(late[1], "b").where(F.col("shared") >= enough - F.least("a_l", "b_l")).select("a", "b")
    near = near if proposed is None else near.union(proposed.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    near = scratch.keep(near, "near")

    wanted = ends.where("l > 0").select("key", "row").union(classes.select("key", "row").join(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("key", "row")).distinct()
    wanted = scratch.keep(wanted, "wanted", count)
    sets = scratch.keep(sets_of(of_classes(rows, wanted), width).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")
    links = scratch.keep(linked(near, sets, percent), "links-0", count)

    if ends.where("l > 0").isEmpty():
        return links
    return scratch.keep(links.union(links_of_long_lists(members.where(~short), ends, links, sets, scratch, percent, count)), "links", count)


def links_of_long_lists(members: DataFrame, ends: DataFrame, links: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, count: int) -> DataFrame:
    """Links a, b between members of one long list (h, key, c) that join what the links so far leave apart.

    First every member meets one centre only, the best of those of its lists; the centre of a list is its member with
    most of its prefix in long lists. Then those still apart from the centre of a list meet it and some members
    drawn from them. Who is apart after that meets all members, but
    only in so many of its lists as a link must show up in: with A long lists and need of them shared with a partner
    of some size, in one of any A - need + 1. Pairs that share a short list, too, were looked up with the short lists if
    they can link, so here all that a link needs must be shared in long ones.
    """
    spark = members.sparkSession
    about = F.struct("key", "n", "late", F.col("l").alias("a"))
    known = ends.where("l > 0").select("key", about.alias("own"))
    placed = scratch.keep(members.join(known, "key").select("h", "c", "key", "own.n", "own.a"), "placed", count)
    prefix = F.col("n") - rest_of(F.col("n"), percent)

    def compared(pairs: DataFrame, turn: str) -> DataFrame:
        """The links among pairs a, b; a pivot b may stand in very many of them."""
        pairs = pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        far = known.select(F.col("key").alias("b"), F.col("own").alias("other")).join(pairs.select("b").distinct(), "b", "left_semi")
        far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pairs.join(far, ["b", "salt"]).join(known.select(F.col("key").alias("a"), "own"), "a")
        need = needed(F.col("own.n"), F.col("other.n"), percent)
        shared = F.size(F.array_intersect("own.late", "other.late"))
        near = scratch.keep(both.where(may_link(F.col("own.n"), F.col("other.n"), percent) & (shared >= need)).select("a", "b"), f"long-near-{turn}", count)
        return scratch.keep(linked(near, sets, percent, SALTS), f"long-links-{turn}", count)

    centres = placed.groupBy("h").agg(F.min_by(F.struct("key", "n", "a"), F.struct(-F.col("a") / prefix, "key")).alias("one"))
    one = F.col("one")
    rank = F.struct(-one["a"] / (one["n"] - rest_of(one["n"], percent)), one["key"])
    centres = scratch.keep(centres.select("h", one["key"].alias("b"), one["n"].alias("m"), one["a"].alias("b_a"), rank.alias("rank")), "centres", count)
    # Prefixes that stand in too few long lists share no link's worth of them with anything of the other's size.
    able = may_link(F.col("n"), F.col("m"), percent) & (needed(F.col("n"), F.col("m"), percent) <= F.least("a", "b_a"))
    found = compared(best_centres(placed.join(centres, "h").where((F.col("key") != F.col("b")) & able)), "0")
    for turn, many in enumerate(DRAWN, 1):
        rooted, apart = apart_from_centres(placed, centres, links.union(found), scratch, f"{turn}", count)
        middles = apart.select("h", F.col("middle").alias("far")).distinct().join(centres, "h").select("h", "b", "far", "m", "b_a") if turn == 1 else None
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40) * F.col("c") < many
        pivots = apart.where(draw).select("h", F.col("key").alias("b"), F.col("root").alias("far"), F.col("n").alias("m"), F.col("a").alias("b_a"))
        pivots = pivots if middles is None else pivots.union(middles)
        pairs = apart.join(pivots, "h").where((F.col("root") != F.col("far")) & able).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
        found = found.union(compared(pairs, f"{turn}"))
    rooted, apart = apart_from_centres(placed, centres, links.union(found), scratch, "all", count)
    wanted = apart.groupBy("key", "n", "a", "root").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("in"))
    enough = F.col("n") * (percent / 100.0) - 1e-6, F.col("n") * (100.0 / percent) + 1e-6
    wanted = wanted.withColumn("t", F.explode(F.sequence(size_class(enough[0]), size_class(enough[1]))))
    # The fewest that must be shared with a partner of a size class: at one of its ends.
    need = F.least(*(needed(F.col("n"), F.pow(F.lit(STEP), F.col("t") + k), percent) for k in (0, 1))) - 1
    wanted = wanted.withColumn("lists", F.slice("in", F.lit(1), F.greatest(F.lit(0), F.least(F.size("in"), (F.col("a") - need + 1).cast("int")))))
    wanted = wanted.select("key", "n", "a", "root", "t", F.explode("lists").alias("at")).select(F.col("key").alias("a_key"), F.col("n").alias("a_n"), F.col("a").alias("a_a"), F.col("root").alias("a_root"), "t", "at.h")
    partners = rooted.withColumn("t", size_class(F.col("n")))
    pairs = wanted.join(partners, ["h", "t"]).where((F.col("a_root") != F.col("root")) & (needed(F.col("a_n"), F.col("n"), percent) <= F.least("a_a", "a")) & may_link(F.col("a_n"), F.col("n"), percent))
    return found.union(compared(pairs.select(F.least("a_key", "key").alias("a"), F.greatest("a_key", "key").alias("b")), "all"))


def best_centres(met: DataFrame) -> DataFrame:
    """a, b: of each key the best of the centres b that it could meet (key, b, rank). Near copies share many lists; a centre for each made as many pairs of every copy."""
    return met.groupBy(F.col("key").alias("a")).agg(F.min_by("b", "rank").alias("b"))


def needed(n: Column, m: Column, percent: int) -> Column:
    """How many shingles of their prefixes linked sets of these sizes share at least."""
    return occurrences(n, m, percent) - F.greatest(rest_of(n, percent), rest_of(m, percent))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(STEP)) + 1e-9).cast("int")


def apart_from_centres(placed: DataFrame, centres: DataFrame, links: DataFrame, scratch: Scratch, turn: str, count: int) -> tuple[DataFrame, DataFrame]:
    """placed with the root of every member's component, and the members in no component of a centre of their list."""
    roots = components(links, Scratch(placed.sparkSession, f"overlap-roots-{turn}")).withColumnRenamed("node", "key")
    rooted = scratch.keep(placed.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), f"rooted-{turn}", count)
    middle = centres.select("h", "b").join(roots.withColumnRenamed("key", "b"), "b", "left").select("h", F.coalesce("root", "b").alias("middle"))
    return rooted, scratch.keep(rooted.join(middle, "h").where("root <> middle"), f"apart-{turn}", count)


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two rows link if their sets of word shingles have 100 * intersection >= percent * union; component_id is the
    smallest doc_id that a chain of links leads to. A text of fewer words than a shingle is one shingle; texts
    without words and nulls have the empty set, which links with nothing. Rows without doc_id take part and get
    the component's id (null where no row of it has one); repeated rows each get their row. An empty table
    gives no rows; columns other than the two named are not read.

    Equal sets are one class. Two classes of sizes n and m link only if they share T shingles, so each has
    one of the other's among its first ones in any common order (its prefix). Lists of shingles that stand in
    few prefixes are merged on a heap for every class, and candidates in T less the lists not merged are
    looked up in each other's sets by halving. Long lists stand last in the order; those still in a prefix,
    of classes that consist of little else, are not paired out: their members meet centres first, and only those
    left apart and able to link with the sizes there go on.
    """
    scratch = Scratch(docs.sparkSession, "overlap")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    marked = scratch.keep(marked_sets(rows, width, percent), "marked")
    count = marked.count()
    grouped = marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.min_by(F.struct("row", "start"), "row").alias("one"), F.count("*").alias("copies"))
    classes = scratch.keep(grouped.select("key", "least", "n", "one.row", "one.start", "copies"), "classes")
    links = links_of_classes(classes.where("n > 0"), rows, scratch, width, percent, count)
    roots = components(links, Scratch(docs.sparkSession, "overlap-components")).withColumnRenamed("node", "key")
    linked_classes = roots.join(classes.select("key", "least"), "key")
    groups = linked_classes.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("size"))
    lowest = scratch.keep(joined_by_key(linked_classes, groups, ["root"], "size", scratch).select("key", "lowest"), "lowest", count)
    known = classes.where("n > 0").join(lowest, "key", "left").select("key", "copies", F.coalesce("lowest", "least").alias("component_id"))
    known = scratch.keep(known, "known", count)
    scratch.only("marked", "known")
    empty = marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = joined_by_key(marked.where("n > 0").select("doc_id", "n", "key"), known, ["key"], "copies", scratch).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(empty)
