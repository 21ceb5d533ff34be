import corpus_pipeline
from hearthlake.llm import contamination, quality, registry
from tests.llm.helpers import EDGES, clashing_docs
from tests.llm.test_line_dedup import brute as lines_by_hand
from tests.llm.test_resemblance import brute as first_of_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]

    good = stages["quality classifier"](spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~registry.held_out(1, 3))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d for d, t in texts.items() if model.scores([quality.passages(t)])[0] >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == columns

    cut = stages["line dedup"](spark, good, SF)
    kept = [(d, t) for d, t in texts.items() if d in want]
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == lines_by_hand(kept) and cut.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    apart = stages["SimHash near-dedup"](spark, docs, SF)
    assert {r["doc_id"] for r in apart.collect()} == first_of_groups(sorted(texts.items())) and apart.columns == columns

    clean = stages["benchmark decontamination"](spark, docs, SF)
    items = [contamination.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, t in texts.items() if any(i and i in contamination.normalised(t) for i in items)}
    assert not held & {r["doc_id"] for r in clean.collect()} and len(texts) - clean.count() <= len(held) + 2 and clean.columns == columns

    coded = stages["SentencePiece encoding and decoding"](spark, docs, SF)
    assert {r["doc_id"]: r["text"] for r in coded.collect()} == texts
    assert all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in coded.collect() if r["text"])


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_on_edge_rows(spark):
    """Nulls, empty and very long texts, repeated ids and rows, clashing names: every stage but the filters keeps every row."""
    docs = clashing_docs(spark).selectExpr("*", "1 AS n_tokens", "CAST(NULL AS ARRAY<INT>) AS token_ids", "2 AS score", "3 AS _mark", "4 AS lowest")
    more = spark.createDataFrame([(8, "y y y y y y y")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        found = stage(spark, docs, SF)
        rows = found.collect()
        if name == "SentencePiece encoding and decoding":
            assert sorted(found.columns) == sorted(docs.columns) and all(r["n_tokens"] == len(r["token_ids"] or []) for r in rows)
        else:
            assert found.columns == docs.columns
        if name in ("line dedup", "SentencePiece encoding and decoding", "benchmark decontamination"):
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted([(d, t) for d, t, *_ in EDGES] + [(8, "y y y y y y y")], key=repr)
        if name == "SimHash near-dedup":
            # 1, 2 and 3 have no word; 5, 6 and 7 the same ones; rows of one id stay together.
            assert sorted(((r["doc_id"]) for r in rows), key=repr) == sorted([1, 4, 5, None, 8, 8, 8, 9], key=repr)
        assert stage(spark, docs.where("doc_id < -5"), SF).count() == 0
    judged = stages["quality classifier"](spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~registry.held_out(1, 3))
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if model is None or model.scores([quality.passages(r["text"])])[0] >= 0.5]
    assert sorted(((r["doc_id"], r["text"]) for r in judged.collect()), key=repr) == sorted(want, key=repr)
