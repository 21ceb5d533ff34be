import random

from hearthlake.llm import contamination as C
from tests.llm.helpers import clashing_docs, edge_docs, no_docs, rows


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def bits(pattern):
    table = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    return table


def edited(draw, text, n):
    text = list(text)
    for _ in range(n):
        at = draw.randrange(len(text))
        what = draw.randrange(3)
        text[at : at + (what != 0)] = [draw.choice("abc ")] if what != 1 else []
    return "".join(text)


def test_bit_parallel_distance_equals_the_matrix():
    draw = random.Random(5)
    for _ in range(300):
        pattern = "".join(draw.choices("ab c", k=draw.randint(1, 80)))
        text = edited(draw, "".join(draw.choices("ab c", k=20)) + pattern, draw.randint(0, 9)) + "c" * draw.randint(0, 5)
        assert C.best_match(bits(pattern), len(pattern), text)[0] == least_distance(pattern, text)


def test_pieces_cover_the_item():
    for length in (1, 7, 60, 301):
        found = C.pieces(length, length // 12)
        assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == length


def test_finds_what_brute_force_finds(spark, monkeypatch):
    draw = random.Random(6)
    letters = "abcdefghijklmnop "
    items = [(i, "".join(draw.choices(letters, k=draw.randint(10, 120))).strip()) for i in range(12)] + [(12, None), (13, "  "), (14, "Short One")]
    docs = []
    for d in range(80):
        text = "".join(draw.choices(letters, k=draw.randint(0, 150)))
        if d % 3 == 0:
            item = draw.choice(items[:12])[1]
            text += " " + edited(draw, item, draw.randint(0, max(1, len(item) // 9))).upper().replace(" ", " \n ") + " " + text
        docs.append((d, text))
    rate = C.ERROR_RATE
    want = set()
    for d, text in docs:
        for i, item in items:
            if C.normalised(item) and (distance := least_distance(C.normalised(item), C.normalised(text))) <= int(rate * len(C.normalised(item))):
                want.add((d, i, distance))
    assert sum(1 for _, _, n in want if n) > 3
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in C.find_leaks(documents, benchmark).collect()} == want
    monkeypatch.setattr(C, "BLOCK", 200)  # several passes
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in C.find_leaks(documents, benchmark).collect()} == want
    assert {r["doc_id"] for r in C.without_leaks(documents, benchmark).collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_edges(spark):
    benchmark = spark.createDataFrame([(1, "One TWO three\nfour"), (1, "One TWO three\nfour"), (None, "five six")], "item_id long, text string")
    assert rows(C.find_leaks(edge_docs(spark), benchmark), "doc_id", "item_id", "distance") == sorted([(d, i, 0) for d in (5, 6, 7, None) for i in (1, 1, None)], key=repr)
    assert C.without_leaks(clashing_docs(spark), benchmark).columns == clashing_docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in C.without_leaks(clashing_docs(spark), benchmark).collect()) == [0, 1, 2, 3, 4, 8, 8, 9]
    assert C.find_leaks(no_docs(spark), benchmark).count() == 0
    assert C.find_leaks(edge_docs(spark), benchmark.limit(0)).count() == 0


def test_item_identifiers_of_any_type(spark):
    docs = spark.createDataFrame([(1, "here is a benchmark question of some length, indeed"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", "a benchmark question of some length"), (None, "is a benchmark"), ("q-3", None)], "item_id string, text string")
    found = C.find_leaks(docs, items)
    assert dict(found.dtypes)["item_id"] == "string"
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()), key=repr) == sorted([(1, "q-1", 0), (1, None, 0)], key=repr)
    assert C.without_leaks(docs, items).count() == 1


def test_pieces_are_found_wherever_they_stand_in_long_texts(monkeypatch):
    monkeypatch.setattr(C, "WINDOW", 64)
    draw = random.Random(9)
    letters = "abcdefé中\U0001F600 "
    items = [(i, "".join(draw.choices(letters, k=n))) for i, n in enumerate((3, 5, 7, 40, 90, 200, 13, 26))]
    for rate in (0.08, 0.3):  # at the second rate many pieces are shorter than GRAM
        matcher = C.Matcher(items, rate)
        for _ in range(120):
            text = "".join(draw.choices(letters, k=draw.randint(0, 300)))
            item = draw.choice(items)[1]
            text += edited(draw, item, draw.randint(0, int(rate * len(item)))) + text[::-1]
            want = [(k, d) for k, x in items if (d := least_distance(x, text)) <= int(rate * len(x))]
            assert [(k, d) for k, d, _ in matcher.matches(text)] == want
