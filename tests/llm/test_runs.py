import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from hearthlake.llm.runs import Extensions, Grid, Minima, looped, periodic_runs, read_words, runs_of
from tests.llm.helpers import EDGES, clashing_docs, edge_docs, no_docs, rows


def brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text, loop=True):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if loop and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in found)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(b" ".join(kept)))


def some_words(rng):
    n, kinds = rng.randrange(0, 130), rng.choice([1, 2, 3, 5, 40])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 3 + 1))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)] + [rng.randrange(kinds) for _ in range(rng.choice((0, 20)))]
    return words


def test_extensions_equal_comparing_word_by_word():
    rng = random.Random(2)
    for _ in range(60):
        ids = np.array(some_words(rng) or [0], np.int32)
        n, both = len(ids), Extensions(ids)
        pairs = np.array([(rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(40)])
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        wanted = []
        for a, b in pairs.tolist():
            k = 0
            while max(a, b) + k < n and ids[a + k] == ids[b + k]:
                k += 1
            wanted.append(k)
        assert both.agree(pairs[:, 0], pairs[:, 1]).tolist() == wanted


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 500)
    low = rng.integers(0, 499, 800)
    past = np.minimum(500, low + 1 + rng.integers(0, 400, 800))
    assert Minima(values).least(low, past).tolist() == [values[a:b].min() for a, b in zip(low, past, strict=True)]


@pytest.mark.parametrize(("usual", "chunk"), [(1 << 14, 1 << 20), (64, 16)])
def test_runs_equal_brute_force(usual, chunk):
    rng, points = random.Random(1), Grid(usual, chunk)
    for _ in range(1500):
        words = some_words(rng)
        assert list(zip(*(x.tolist() for x in runs_of(np.array(words, np.int32), points)), strict=True)) == brute_runs(words)


def test_words_of_a_long_text_are_read_in_pieces():
    text = b" ".join(b"w%d" % (i % 977) for i in range(400_000))
    ids, words = read_words(memoryview(text))
    assert [words[i] for i in ids[::5003].tolist()] == text.split()[::5003] and len(words) == 977


def test_every_tenth_text_repeats_itself():
    ids = np.arange(50)
    assert looped(ids, 11).tolist() == list(range(50)) and looped(np.arange(0), 10).tolist() == []
    a, p = 13 % 50, 1 + 37 // (3 + 13 % 8)
    assert looped(ids, 130).tolist() == [i if i < a else a + (i - a) % p for i in range(50)]


def test_query_rows_equal_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"W{w}" for w in some_words(rng))) for i in range(400)] + [(5, "a b " * 40), (5, None), (77, "x y z\u000bz z z z z z")]
    found = periodic_runs(spark.createDataFrame(docs, "doc_id long, text string"), loop=True)
    assert rows(found) == sorted((brute(*d) for d in docs), key=repr)
    assert found.where("n_runs > 0").count() > 100


def test_edges(spark):
    assert rows(periodic_runs(edge_docs(spark))) == rows(periodic_runs(clashing_docs(spark)))
    found = {r["doc_id"]: r for r in periodic_runs(edge_docs(spark)).collect()}
    assert (found[4]["n_runs"], found[4]["start"], found[4]["length"], found[4]["period"]) == (1, 0, 36_000, 3)
    assert found[1]["n_runs"] == 0 and found[1]["start"] is None and found[1]["collapsed_sha256"] == hashlib.sha256().hexdigest() == found[3]["collapsed_sha256"]
    short = [e for e in EDGES if e[0] != 4]
    table = spark.createDataFrame(short, "doc_id long, text string, lang string, source string")
    assert rows(periodic_runs(table, loop=True)) == sorted((brute(d, t) for d, t, *_ in short), key=repr)
    assert periodic_runs(no_docs(spark)).count() == 0
