import random

import numpy as np
import pytest

from hearthlake.llm.line_dedup import BASE, CHUNK, CLOSING, MARKS, PARAGRAPH, SENTENCE, SPACING, WORD, Cutter, slices, without_repeats
from tests.llm.helpers import EDGES, clashing_docs, no_docs


def sentence(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))


def units_by_hand(data):
    """(begin, end, whole line) of the units of one text, one byte at a time."""
    found, at = [], 0
    for line in data.split(b"\n"):
        words, begin = [], None
        for i in range(len(line) + 1):
            inked = i < len(line) and line[i] > 32
            if begin is None and inked:
                begin = i
            elif begin is not None and not inked:
                words.append((begin, i))
                begin = None
        if words:
            low, high = words[0][0], words[-1][1]
            if high - low < PARAGRAPH:
                found.append((at + low, at + high, True))
            else:
                sentences, own = [], []
                for a, b in words:
                    own.append((a, b))
                    word = line[a:b]
                    if word[-1] in MARKS or word[-1] in CLOSING and len(word) > 1 and word[-2] in MARKS or b == high:
                        sentences.append(own)
                        own = []
                for own in sentences:
                    begin = own[0][0]
                    for k, (a, b) in enumerate(own):
                        word = line[a:b]
                        tail = int.from_bytes(word[:-5:-1], "big") << 8 * max(0, 4 - len(word))
                        chosen = own[-1][1] - own[0][0] >= SENTENCE and (tail * BASE % WORD >> 40) % SPACING == 0
                        if chosen or k + 1 == len(own):
                            found.append((at + begin, at + b, False))
                            begin = own[k + 1][0] if k + 1 < len(own) else b
        at += len(line) + 1
    return found


def brute(docs):
    """Texts by row of docs (id, text), ids different: pairs as bytes, firsts in order, longest runs."""
    cut, places = {}, {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        cut[d] = data, units_by_hand(data)
        units = cut[d][1]
        for k in range(len(units) - 1):
            places.setdefault(data[units[k][0] : units[k + 1][1]], []).append((d, k))
    out = {}
    for d, text in docs:
        data, units = cut[d]
        seen = [places[data[units[k][0] : units[k + 1][1]]] for k in range(len(units) - 1)]
        gone, k = set(), 0
        while k < len(seen):
            if seen[k][0] == (d, k):
                k += 1
                continue
            past = k
            while past < len(seen) and seen[past][0] != (d, past):
                past += 1
            if units[past][1] - units[k][0] >= CHUNK or sum(u[2] for u in units[k : past + 1]) >= 2:
                for j in range(k, past):
                    gone |= {j + 1} if seen[j][0] == (d, j - 1) else {j, j + 1}
            k = past
        ends = [u[0] for u in units[1:]] + [len(data)]
        left, at = b"", 0
        for j in sorted(gone):
            left, at = left + data[at : units[j][0]], ends[j]
        left += data[at:]
        if len(units) - 1 in gone:
            left = left.rstrip(b" \t\r\n")
        out[d] = left.decode() if text is not None else None
    return out


def texts_of(spark, docs, **options):
    return {r["doc_id"]: r["text"] for r in without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}


def some_docs(seed=4):
    draw = random.Random(seed)
    shared = ["\n".join(sentence(draw, draw.randint(4, 12)) for _ in range(9)) for _ in range(3)]
    shared += [sentence(draw, 60), ". ".join(sentence(draw, 9) for _ in range(8)) + ".", "é ".join(sentence(draw, 5) for _ in range(12)), "a\n\n \nb", "x\nx\nx\nx\nx"]
    docs = []
    for i in range(80):
        own = [sentence(draw, draw.randint(1, 40)) for _ in range(draw.randint(1, 6))]
        for _ in range(i % 3):
            own.insert(draw.randint(0, len(own)), draw.choice(shared))
        docs.append((i, draw.choice(["\n", "\n\n", " "]).join(own) + draw.choice(["", "\n", "  \n"])))
    return docs


def test_units_are_those_found_by_hand():
    cutter = Cutter()
    texts = [t for _, t in some_docs(2)] + ["", " \n", "x", 'He said "no!" ' * 20, "one, two. " * 60]
    at = 0
    import pyarrow as pa

    for row, data, offsets in slices(pa.array(texts)):
        units = cutter.units(data, offsets)
        for k in range(len(offsets) - 1):
            own = units.text == k
            found = list(zip((units.begin[own] - offsets[k]).tolist(), (units.end[own] - offsets[k]).tolist(), units.whole[own].astype(bool).tolist(), strict=True))
            assert found == units_by_hand(texts[row + k].encode())
            at += 1
    assert at == len(texts)


def test_hashes_depend_on_bytes_alone():
    cutter = Cutter()
    line = b"a line of words"
    far = b"." * (3 << 18) + b"\n" + line + b"\n" + line
    begin = np.array([far.index(line), far.rindex(line)])
    one, two = cutter.hashes(np.frombuffer(far, np.uint8), begin, begin + len(line))
    alone = cutter.hashes(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]))[0]
    assert one == two == alone != cutter.hashes(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line) - 1]))[0]


def test_equals_brute_force(spark):
    docs = some_docs()
    for bits in (64, 3):  # with three bits everything clashes
        assert texts_of(spark, docs, bits=bits) == brute(docs)


def passages_cut(spark, passages, insert, seed):
    """Share of the characters of passages that go after their first occurrence; own text must stay."""
    draw, docs, owns = random.Random(seed + 100), [], {}
    for i in range(400):
        own = [sentence(draw, draw.randint(4, 12)) for _ in range(draw.randint(2, 9))]
        docs.append((i, insert(draw, own, passages[i % len(passages)])))
        owns[i] = sum(len(x) for x in own)
    texts = texts_of(spark, docs)
    later = [(i, t) for i, t in docs if i >= len(passages)]
    assert all(texts[i] == t for i, t in docs[: len(passages)])
    assert all(len(texts[i].replace("\n", "")) >= owns[i] for i, _ in later)
    return sum(len(t) - len(texts[i]) for i, t in later) / sum(len(passages[i % len(passages)]) for i, _ in later)


@pytest.mark.parametrize(("lines", "words"), [(2, (7, 12)), (3, (4, 12)), (5, (4, 12)), (9, (4, 12)), (20, (4, 12)), (3, (2, 3)), (5, (1, 2))])
def test_passages_of_lines_go_wherever_they_stand(spark, lines, words):
    draw = random.Random(lines)
    passages = ["\n".join(sentence(draw, draw.randint(*words)) for _ in range(lines)) for _ in range(4)]

    def insert(draw, own, passage):
        at = draw.randint(0, len(own))
        return "\n".join([*own[:at], passage, *own[at:]])

    assert passages_cut(spark, passages, insert, lines) >= 0.99


def test_passages_in_paragraphs_go(spark):
    """Whole sentences of 51 to 90 words anywhere in a paragraph go whole; with no mark at all, all but their ends."""
    draw = random.Random(8)
    marked = [" ".join(sentence(draw, 9).capitalize() + "." for _ in range(6 + k)) for k in range(4)]
    bare = [sentence(draw, 60 + 10 * k) for k in range(4)]

    def insert(end):
        def put(draw, own, passage):
            at = draw.randint(0, len(own))
            return " ".join([*(x + end for x in own[:at]), passage, *(x + end for x in own[at:])])

        return put

    assert passages_cut(spark, marked, insert("."), 1) >= 0.99
    assert passages_cut(spark, bare, insert(""), 2) >= 0.7


def clauses(draw, n, least=8, most=16):
    """About n words in sentences, some with a comma."""
    out = []
    while len(out) < n:
        some = sentence(draw, min(draw.randint(least, most), n - len(out))).split()
        if len(some) > 8:
            some[4] += ","
        some[-1] += "."
        out += some
    return out


def test_passages_of_51_to_90_words_go_at_random_places(spark):
    draw, docs, passages = random.Random(11), [], []
    for i in range(100):
        passage = clauses(draw, draw.randint(51, 90))
        passages.append(passage)
        for k in range(2):
            own = clauses(draw, draw.randint(60, 150))
            at = draw.randint(0, len(own))  # inside a sentence, too
            docs.append((i + 1000 * k, " ".join([*own[:at], *passage, *own[at:]])))
    texts = texts_of(spark, docs)
    assert texts == brute(docs)
    given = dict(docs)
    gone = [len(given[i + 1000].split()) - len(texts[i + 1000].split()) for i in range(100)]
    assert all(texts[i] == given[i] for i in range(100))
    assert all(n <= len(p) for n, p in zip(gone, passages, strict=True))
    assert sum(n > 0 for n in gone) >= 95 and sum(gone) >= 0.9 * sum(map(len, passages))


def test_passages_of_two_to_four_short_lines_go(spark):
    draw, docs = random.Random(12), []
    for i in range(60):
        passage = [sentence(draw, draw.randint(26, 48)) for _ in range(2 + i % 3)]
        docs += [(i + 1000 * k, "\n".join([sentence(draw, 20), *passage, sentence(draw, 9)])) for k in range(2)]
    texts = texts_of(spark, docs)
    given = dict(docs)
    assert all(texts[i] == given[i] and len(texts[i + 1000].split()) == 29 for i in range(60))


def test_rows_that_share_an_id_are_told_apart(spark):
    draw = random.Random(5)
    a = "\n".join(sentence(draw, 9) for _ in range(8))
    b = "\n".join(sentence(draw, 9) for _ in range(8))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, "short"), (2, "short"), (3, b), (3, b)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["text"]) for r in without_repeats(docs).collect())
    assert found == sorted([(1, a), (2, ""), (2, b), (2, "short"), (2, "short"), (3, ""), (3, "")])


def test_a_line_repeated_in_a_row_stays_twice(spark):
    docs = [(1, "same line\n" * 9), (2, "own\n" + "other line\n" * 3 + "end")]
    assert texts_of(spark, docs) == {1: "same line\nsame line", 2: "own\nother line\nother line\nend"}
    assert texts_of(spark, docs) == brute(docs)


def test_single_lines_and_short_parts_stay(spark):
    draw = random.Random(13)
    line, clause = sentence(draw, 9), "In this case, of course, nothing else applies."
    docs = [(i, f"{sentence(draw, 7)}\n{line}\n{sentence(draw, 40)}. {clause} {sentence(draw, 20)}") for i in range(30)]
    assert texts_of(spark, docs) == dict(docs)


def test_edges_and_report(spark):
    docs = clashing_docs(spark)
    found = without_repeats(docs, report=True)
    assert found.columns == [*docs.columns, "removed", "removed_chars"]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(((d, t) for d, t, *_ in EDGES), key=repr)
    assert without_repeats(no_docs(spark), report=True).count() == 0
    assert found.where("removed > 0").count() == 0
    taken = docs.selectExpr("*", "1 AS removed", "2 AS Removed_Chars", "3 AS _entries", "4 AS _mark")
    named = without_repeats(taken, report=True)
    assert named.columns == [*taken.columns, "removed_", "removed_chars_"] and named.count() == docs.count()


def test_a_very_long_text_is_cut_whole(spark):
    draw = random.Random(21)
    passage = "\n".join(sentence(draw, 8) for _ in range(6))
    long = "\n".join([*(sentence(draw, 9) for _ in range(30_000)), passage, *(sentence(draw, 9) for _ in range(100))])
    texts = texts_of(spark, [(1, passage + "\nhead"), (2, long)])
    assert texts[1] == passage + "\nhead" and texts[2] == long.replace(passage + "\n", "")
