import random
from itertools import combinations

import pytest

from hearthlake.llm import overlap
from hearthlake.llm.simhash import one_of_each_group
from hearthlake.llm.words import shingle_set
from tests.llm.helpers import no_docs


def jaccard(a, b):
    a, b = (set(shingle_set(t.encode(), 5, 42).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def text(draw, n):
    return ["".join(draw.choices("abcdefghij", k=5)) for _ in range(n)]


def changed(draw, words, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = "".join(draw.choices("klmnopqrst", k=5))
    return words


def some_docs():
    draw, docs = random.Random(5), []
    for _ in range(25):
        base = text(draw, draw.randint(60, 300))
        docs += [" ".join(base)] + [" ".join(changed(draw, base, draw.randint(1, max(1, len(base) // 30)))) for _ in range(draw.choice((1, 2, 6)))]
    draw.shuffle(docs)
    return list(enumerate(docs))


def brute(docs):
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (d, s), (e, t) in combinations(docs, 2):
        if jaccard(s, t) >= 0.8:
            low, high = sorted((find(d), find(e)))
            root[high] = low
    return {d for d in root if find(d) == d}


@pytest.mark.parametrize("short", (32, 2))
def test_near_copies_equal_brute_force_in_short_and_long_lists(spark, monkeypatch, short):
    monkeypatch.setattr(overlap, "SHORT", short)
    docs = some_docs()
    assert len(brute(docs)) < len(docs)
    kept = one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == brute(docs)


def test_texts_alike_in_few_bits_only_stay(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "A  b c d e f")]
    assert {r["doc_id"] for r in one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1, 2}
    assert one_of_each_group(no_docs(spark)).count() == 0


def test_one_template_makes_few_comparisons(spark, monkeypatch):
    draw = random.Random(4)
    common = text(draw, 120)
    docs = [(i, " ".join(common + text(draw, 55))) for i in range(2000)]
    seen, probed = [], overlap.probed
    monkeypatch.setattr(overlap, "probed", lambda pairs, percent: seen.append(pairs.count()) or probed(pairs, percent))
    assert one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).count() == 2000
    assert sum(seen) < 2 * len(docs)
