import re
from collections import defaultdict

from pyspark.sql import functions as F

from hearthlake.llm.exact_dedup import DigestIndex, exact_dedup
from hearthlake.llm.shared import Scratch
from tests.llm.helpers import EDGES, clashing_docs, edge_docs, no_docs, rows


def brute(docs):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t, *_ in docs:
        groups[norm(t)].append(d)
    keep = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)]) for d, t, *_ in docs), key=repr)


def test_equals_brute_force_on_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        assert rows(exact_dedup(docs).drop("digest")) == brute(EDGES)
    assert exact_dedup(no_docs(spark)).count() == 0


def test_texts_that_share_a_digest_part_again(spark):
    docs = [(i, f"text {i % 7}{' ' * (i % 3)}") for i in range(60)]
    found = exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), digest=lambda t: F.substring(F.unhex(F.md5(t)), 1, 0))
    assert rows(found.drop("digest")) == brute(docs)
    found = exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0")))
    assert rows(found.drop("digest")) == brute(docs)


def test_runs_of_several_batches_compact_to_the_smallest_id(spark):
    index = DigestIndex(Scratch(spark, "test"))
    for batch in ([(5, "a"), (6, "b")], [(2, "a"), (9, "c")], [(7, "b")]):
        index.append(spark.createDataFrame(batch, "doc_id long, text string"), "doc_id", "text", memtables=1)
    assert [len(level) for level in index.levels] == [3] and rows(index.entries(), "doc_id") == [(2,), (5,), (6,), (7,), (9,)]
    assert rows(index.compact(), "keep_id", "n") == [(2, 2), (6, 2), (9, 1)] and [len(level) for level in index.levels] == [3, 2, 1]
    index = DigestIndex(Scratch(spark, "test"))
    index.append(spark.createDataFrame([(i, f"t{i % 50}") for i in range(400)], "doc_id long, text string"), "doc_id", "text")
    assert len(index.levels[0]) == 4 and rows(index.compact(), "keep_id", "n") == [(i, 8) for i in sorted(range(50), key=lambda i: repr((i, 8)))]
