"""Small documents that every operator must survive, and rows as plain values."""

LONG = "Über den Wolken " * 12_000
EDGES = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "b"), (4, LONG, "de", "b"), (5, "one two three four five six", "en", "a"),
    (6, "one two three four five six", "en", "a"), (7, "one  two\tthree four five six", None, None), (None, "one two three four five six", "en", "a"),
    (8, "x", "en", "c"), (8, "x", "en", "c"), (9, "▁ <0x41> </s> \U0001F600 ́", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside, as columns of the caller.
CLASHING = "doc_id long, text string, lang string, source string, digest string, _maybe int, page long, fp long, bitmap string"


def edge_docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def clashing_docs(spark):
    return spark.createDataFrame([(*r, "d", 1, 2, 3, "b") for r in EDGES], CLASHING)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)
