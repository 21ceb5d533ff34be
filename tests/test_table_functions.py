"""Table functions: their columns follow from their arguments, and unknown names are errors that list the known ones."""

import tracemalloc

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row

from hearthlake.sources.functions import ADAPTERS, PerKey, register_functions


@pytest.fixture
def seen(spark):
    register_functions(spark)
    spark.createDataFrame([("a", 2, 5, "x"), ("a", 1, 9, "x"), ("b", 1, None, "x"), (None, 3, 4, "x")], "k string, at long, price long, other string").createOrReplaceTempView("seen")


def test_columns_follow_from_the_name_and_the_key(spark, seen):
    found = spark.sql("SELECT * FROM per_key(TABLE(seen), 'price_changes', 'k')")
    assert found.columns == ["k", "at", "price", "before", "status"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", 1, 9, None, "new"), ("a", 2, 5, 9, "price_drop"), ("b", 1, None, None, "new"), (None, 3, 4, None, "new")], key=repr)
    assert spark.sql("SELECT * FROM per_key(TABLE(seen), 'spans', 'other')").collect()[0].asDict() == {"other": "x", "first_at": 1, "last_at": 3, "n": 4}
    assert {r["name"] for r in spark.sql("SELECT * FROM adapters()").collect()} == set(ADAPTERS)
    assert spark.sql("SELECT * FROM per_key(TABLE(SELECT * FROM seen WHERE false), 'spans', 'k')").count() == 0


def test_rows_of_a_key_are_not_kept():
    call = PerKey()
    tracemalloc.start()
    for i in range(50_000):
        assert not list(call.eval(Row(k="a", at=i, price=i), "spans", "k"))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert list(call.terminate()) == [("a", 0, 49_999, 50_000)]
    assert held < 1 << 20


def test_unknown_names_are_listed(spark, seen):
    for sql, said in (
        ("SELECT * FROM per_key(TABLE(seen), 'nope', 'k')", "price_changes, spans"),
        ("SELECT * FROM per_key(TABLE(seen), 'spans', 'nope')", "it has k, at, price, other"),
        ("SELECT * FROM page_cards(TABLE(SELECT k AS url, other AS html FROM seen), 'nope')", "franimo"),
        ("SELECT * FROM page_cards(TABLE(seen), 'franimo')", "url and html"),
    ):
        with pytest.raises(AnalysisException, match=said):
            spark.sql(sql)
