import zlib
from collections import Counter, defaultdict

from hearthlake.llm.sharding import balanced_shards, quotas
from tests.llm.helpers import EDGES, clashing_docs, no_docs, rows


def check_law(found, n, shards=8):
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_counts_even_and_copies_together(spark):
    # a third of all rows are one text, more than a shard holds; many small groups
    docs = [(i, "hot") for i in range(300)] + [(1000 + i, f"group {i // 3}") for i in range(300)] + [(5000 + i, f"loose {i}") for i in range(303)]
    found = balanced_shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_law(found, len(docs))
    shards = defaultdict(set)
    for r in found:
        shards[dict(docs)[r["doc_id"]]].add(r["shard"])
    assert len(shards["hot"]) <= 4  # 113 rows a shard
    assert sum(len(v) > 1 for k, v in shards.items() if k.startswith("group")) <= 8
    # By hand: the hot text needs three shards at least, so 300 - 113 of its rows are cut whatever one does.
    parts = Counter((dict(docs)[r["doc_id"]], r["shard"]) for r in found)
    cut = sum(sum(n for (t, _), n in parts.items() if t == text) - max(n for (t, _), n in parts.items() if t == text) for text in shards)
    assert 300 - 113 <= cut <= 300 - 113 + 60


def test_sizes_and_edges(spark):
    found = balanced_shards(clashing_docs(spark)).collect()
    check_law(found, len(EDGES))
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in EDGES), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    assert balanced_shards(no_docs(spark)).count() == 0
    assert rows(balanced_shards(clashing_docs(spark))) == rows(balanced_shards(clashing_docs(spark)))


def test_quotas_admit_greatest_gains_up_to_the_room():
    asked = [{"want": 0, "gain": 1, "n": 10}, {"want": 0, "gain": 3, "n": 4}, {"want": 1, "gain": 0, "n": 5}]
    assert quotas(asked, {0: 9, 1: 0}) == [(0, 3, 1 << 20), (0, 1, (1 << 20) // 2), (1, 0, 0)]
