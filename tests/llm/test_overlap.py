import random

import pytest
from pyspark.sql import functions as F

from hearthlake.llm import overlap
from hearthlake.llm.overlap import jaccard_groups
from tests.llm.helpers import EDGES, clashing_docs, edge_docs, no_docs, rows


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(docs, width=4, percent=85):
    sets = [shingles(t, width) for _, t, *_ in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, *_) in enumerate(docs)), key=repr)


def near_copies(rng, n, bases, spoil):
    """Texts made of shared passages, copies with some words changed, and short ones."""
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(rng.randrange(3, 40))] for _ in range(bases)]
    docs = []
    for i in range(n):
        words = [w for _ in range(rng.randrange(0, 4)) for w in rng.choice(passages)]
        for _ in range(rng.randrange(0, spoil)):
            if words:
                words[rng.randrange(len(words))] = rng.choice([word(), "Word", "WORD"])
        docs.append((i * 7 % 1009, " ".join(words)))
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    docs = near_copies(rng, 300, (12, 4)[seed], (4, 6)[seed])
    wanted = brute(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_groups(table)) == wanted
    # Short lists of 2 or 3: nearly all lists are long and go through the pivots, or behind the others.
    monkeypatch.setattr(overlap, "SHORT", 2 + seed)
    assert rows(jaccard_groups(table)) == wanted


def test_other_widths_and_bounds(spark):
    docs = near_copies(random.Random(9), 120, 6, 4)
    for width, percent in ((1, 60), (3, 100)):
        assert rows(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), width, percent)) == brute(docs, width, percent)


def test_the_bound_itself_links(spark):
    # 17 of 20 shingles is 85 percent exactly; 16 of 19 is less.
    words = [f"a{i}" for i in range(23)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words[1:20]))]
    assert rows(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs) == [(1, 20, 1), (2, 17, 1), (3, 16, 1)]
    assert rows(jaccard_groups(spark.createDataFrame([docs[0], docs[2]], "doc_id long, text string"))) == [(1, 20, 1), (3, 16, 3)]


def test_edges(spark):
    assert rows(jaccard_groups(edge_docs(spark))) == brute(EDGES)
    assert rows(jaccard_groups(clashing_docs(spark))) == brute(EDGES)
    assert jaccard_groups(no_docs(spark)).count() == 0


def test_one_template_makes_few_candidates(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(120)]
    docs = [(i, " ".join(common + [f"own{rng.randrange(10**6)}" for _ in range(55)])) for i in range(1000)]
    seen = []
    probed = overlap.probed
    monkeypatch.setattr(overlap, "probed", lambda pairs, percent: seen.append(pairs.count()) or probed(pairs, percent))
    found = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found.where("doc_id <> component_id").count() == 0 and sum(seen) < 1000


def test_large_group_of_near_copies_meets_centres(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 500):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    seen = []
    probed = overlap.probed
    monkeypatch.setattr(overlap, "probed", lambda pairs, percent: seen.append(pairs.count()) or probed(pairs, percent))
    found = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    # Half of them are too far from each other and stay alone; all pairs would be 125,000.
    assert rows(found) == brute(docs) and sum(seen) < 20 * len(docs)
    assert found.agg(F.countDistinct("component_id")).first()[0] > 100


def test_near_copies_meet_one_centre_first(spark, monkeypatch):
    """Copies that share many long lists met the centre of each: pairs by copies and lists."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(80):
        words = base.copy()
        words[rng.randrange(len(words))] = f"x{i}"
        docs.append((i, " ".join(words)))
    met, real = [], overlap.linked

    def spy(pairs, sets, percent, salts=1):
        if salts > 1:
            met.append(pairs.groupBy("a").count().agg(F.max("count")).first()[0])
        return real(pairs, sets, percent, salts)

    monkeypatch.setattr(overlap, "SHORT", 2)
    monkeypatch.setattr(overlap, "linked", spy)
    assert rows(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert met[0] == 1


def test_pairs_of_long_lists_share_all_that_a_link_needs_there(spark, monkeypatch):
    """Pairs that share a short list were looked up with those; counting short shingles again let pairs through that share too few long lists."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(100)] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    met, real = [], overlap.linked

    def spy(pairs, sets, percent, salts=1):
        if salts > 1:
            met.append(pairs.count())
        return real(pairs, sets, percent, salts)

    monkeypatch.setattr(overlap, "SHORT", 8)
    monkeypatch.setattr(overlap, "linked", spy)
    assert rows(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert sum(met) < 420
