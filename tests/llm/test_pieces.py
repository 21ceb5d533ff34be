import random

import pytest
import sentencepiece

from hearthlake.llm import pieces
from tests.llm.helpers import EDGES, clashing_docs, no_docs


def varint(data, at):
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def as_unigram(path):
    """The model file with its kind set to unigram: the library then searches for the best sum of scores too."""
    data = open(path, "rb").read()
    at, out = 0, b""
    while at < len(data):
        key, body = varint(data, at)
        n, body = varint(data, body)
        field = data[body : body + n]
        if key >> 3 == 2:
            inner = 0
            while inner < len(field):
                k, value = varint(field, inner)
                if k == 3 << 3:
                    field = field[:value] + b"\x01" + field[value + 1 :]
                    break
                if k & 7 == 2:
                    size, value = varint(field, value)
                    inner = value + size
                else:
                    inner = varint(field, value)[1] if k & 7 == 0 else value + (4 if k & 7 == 5 else 8)
        out += data[at:body] + field
        at = body + n
    return sentencepiece.SentencePieceProcessor(model_proto=out)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def sample(seed=3):
    draw = random.Random(seed)
    parts = ["the", "onth", "tion", "é", "ß", " ", "  ", "\n", "\t", ".", "!!", "中", "\U0001F600", "Q", "ñ", "0", "www.", "<s>", "́"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(400)]


def test_scores_equal_the_library_lattice(vocabulary):
    """The library's lattice search over the same pieces finds no better sum; its one-best shortcut does not always reach it."""
    library, encoder = as_unigram(pieces.MODEL), pieces.Encoder(vocabulary)
    total = lambda ids: sum(vocabulary.scores[i] for i in ids)
    for text in ["the", "the onthtion", "where are you going", *sample()]:
        mine = total(memoryview(encoder.encode(text)).cast("i").tolist())
        # beyond 2^24 the library's single-precision sums no longer tell paths apart
        if encoder.single.issuperset(text.replace(" ", pieces.SPACE)) and mine > -(1 << 24):
            assert mine == total(library.nbest_encode(text, nbest_size=2)[0]), text


def test_best_sum_by_brute_force(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    score = {vocabulary.pieces[i]: vocabulary.scores[i] for i in vocabulary.plain}
    for word in ("▁the", "▁thereon", "▁onthtion", "ation", "▁▁▁ab"):
        best = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[a] + score[word[a:end]] for a in range(end) if word[a:end] in score)
        assert sum(vocabulary.scores[i] for i in encoder.viterbi(word)) == best[-1]


def test_round_trip_of_anything(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text in [*sample(5), "▁", " ▁ a▁▁b", "\x00�", " lead", "trail "]:
        assert pieces.decode(vocabulary, memoryview(encoder.encode(text)).cast("i").tolist()) == text


def test_memory_is_bounded_and_forgets_right(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    small, large = pieces.Encoder(vocabulary), pieces.Encoder(vocabulary)
    assert [small.encode(t) for t in sample(8)] == [large.encode(t) for t in sample(8)]
    assert len(small) <= 6 and len(small.before) <= 6


def test_tables(spark):
    docs = clashing_docs(spark)
    found = pieces.decode_ids(pieces.encode_texts(docs))
    assert found.columns == [*docs.columns, "token_ids", "decoded"]
    assert sorted(((r["doc_id"], r["decoded"]) for r in found.collect()), key=repr) == sorted(((d, t) for d, t, *_ in EDGES), key=repr)
    assert pieces.decode_ids(pieces.encode_texts(no_docs(spark))).count() == 0
    twice = pieces.encode_texts(found).columns
    assert twice.count("token_ids") == 1


def test_long_segments_have_the_paths_of_short_ones(monkeypatch):
    draw = random.Random(3)
    encoder = pieces.Encoder(pieces.Vocabulary())
    text = pieces.SPACE + "".join(draw.choice(["the", "ing", "x", "é", "\U0001F600", "中文", "zz", "▂"]) for _ in range(4000))
    packed = encoder.viterbi(text)
    monkeypatch.setattr(pieces, "LONG", 1 << 40)
    assert list(packed) == encoder.viterbi(text) and len(packed) > 3000
    encoder[text], encoder["short"]
    assert "short" in encoder and text not in encoder
