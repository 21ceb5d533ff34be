"""The trigram index finds what a scan of all texts finds, and reads candidates only."""

import random

from pyspark.sql import functions as F

from hearthlake.operators.text_index import TextIndex, grams_of

WORDS = ["huis", "Maison", "à", "vendre", "日本語テキスト", "bij", "zee", "seaside", "sea", "house", "houses", "x", "ab"]


def some_rows(rng, n):
    return [(rng.randrange(-200_000, 200_000), None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randrange(0, 6)))) for _ in range(n)]


def test_equals_a_scan(spark, tmp_path):
    rng = random.Random(1)
    rows = list({i: (i, t) for i, t in some_rows(rng, 600)}.values())
    index = TextIndex(spark, f"{tmp_path}/index")
    for part in (rows[:400], rows[400:]):
        index.add(spark.createDataFrame(part, "id long, text string"), "id", F.col("text"))
    for query in ("huis", "HOUSE sea", "maison à", "ab", "  ", "本語テ", "nothing", "house nothing", "x zee", "ouse"):
        terms = query.lower().split()
        wanted = sorted(i for i, t in rows if all(w in (t or "").lower() for w in terms))
        assert sorted(r["id"] for r in index.search(query).collect()) == wanted, query
    assert index.candidates(["ab", "x"]) is None and grams_of("abcd") == ["abc", "bcd"] and grams_of("ab") == []
    assert "In(gram" in index.candidates(["house"])._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_few(spark, tmp_path):
    rows = [(i, f"word{i} common") for i in range(3000)]
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    assert index.candidates(["word2999"]).count() < 20 and [r["id"] for r in index.search("word2999 common").collect()] == [2999]
    assert index.search("common").count() == 3000


def test_texts_lie_by_ranges_of_identifiers(spark, tmp_path):
    """So that a task's partial bitmaps are those of few pages, however the rows came."""
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(spark.range(3000).repartition(4).select("id", F.concat(F.lit("word"), "id").alias("text")), "id", F.col("text"))
    spans = index.texts().groupBy(F.input_file_name()).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:], strict=False))


def test_identifiers_are_not_broadcast(spark, tmp_path):
    """A list of identifiers made from bitmaps looks as small as they are; what goes through the driver is the bitmaps, if anything."""
    index = TextIndex(spark, f"{tmp_path}/index")
    index.add(spark.range(-40_000, 40_000).select("id", F.lit("common word").alias("text")), "id", F.col("text"))
    found = index.search("common")
    assert found.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first() == (80_000, 80_000, -40_000, 39_999)
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan, plan
