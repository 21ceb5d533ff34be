import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

from hearthlake.llm import simhash
from hearthlake.llm.components import components
from hearthlake.llm.shared import Scratch
from hearthlake.llm.simhash import bit_counts, covering_masks, fingerprint, near_groups, near_links, one_of_each_group
from tests.llm.helpers import EDGES, clashing_docs, edge_docs, no_docs, rows


def naive(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def linked(words, radius):
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for a, b in combinations(sorted(words), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {w: find(w) for w in words}


def test_fingerprint_by_hand():
    for text in (None, "", "A", "A b", "a B c", "Ä É x y", "\x0b one\ttwo\x0cthree four", "w " * 700 + "end"):
        for width in (3, 5):
            assert fingerprint(text, width) == naive(text, width)


def test_some_mask_leaves_out_any_few_bits():
    draw = random.Random(1)
    for radius in (2, 3, 4):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flipped = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(not m & flipped for m in masks)


def some_words():
    draw, words = random.Random(2), set()
    for _ in range(30):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice((1, 2, 12))):
            word = centre
            for b in draw.sample(range(64), draw.randint(0, 3)):
                word ^= 1 << b
            words.add(word - (1 << 64) if word >> 63 else word)
    return words


def test_components_equal_brute_force_in_small_and_large_buckets(spark, monkeypatch):
    words = some_words()
    frame = spark.createDataFrame([(w,) for w in words], "fp long")
    for direct in (128, 1):
        monkeypatch.setattr(simhash, "DIRECT", direct)
        for radius in (2, 4) if direct > 1 else (2,):
            scratch = Scratch(spark, "test")
            links = scratch.keep(near_links(frame, radius, scratch), "near")
            found = {r["node"]: r["root"] for r in components(links, scratch).collect()}
            assert {w: found.get(w, w) for w in words} == linked(words, radius)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["root"] for r in components(links, Scratch(spark, "test")).collect()} == {0}


def test_groups_on_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        found = near_groups(docs)
        roots = linked({naive(t) for _, t, *_ in EDGES}, 2)
        least = {}
        for d, t, *_ in EDGES:
            if d is not None:
                least[roots[naive(t)]] = min(d, least.get(roots[naive(t)], d))
        assert rows(found) == sorted(((d, naive(t), least[roots[naive(t)]]) for d, t, *_ in EDGES), key=repr)
    assert near_groups(no_docs(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = clashing_docs(spark)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, None, 8, 8, 9])


def test_a_long_text_is_read_in_pieces():
    text = " ".join(f"word{i % 9973}" for i in range(900_000))  # 8 MB
    data = memoryview(text.encode())
    tracemalloc.start()
    found = fingerprint(data, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Less than eight times a piece's bytes a word, and nothing that grows with the text.
    assert peak < 60_000_000
    words = text.split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(three), 42) for three in zip(words, words[1:], words[2:], strict=False)), "<u8")
    counts = bit_counts(hashes)
    assert found == int(np.packbits(2 * counts > 899_998, bitorder="little").view("<i8")[0])
