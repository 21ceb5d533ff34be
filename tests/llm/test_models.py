"""The three fitted operators: accuracy on held-out documents, mathematics by hand, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.llm import language, quality, registry, toxicity
from tests.llm.helpers import EDGES, clashing_docs, no_docs

SF = "/root/testdata/sf0.01"


def held_out_accuracy(found, truth, predicted, column):
    joined = found.where("held_out").join(truth, "doc_id").select(predicted, column).collect()
    return sum(r[0] == r[1] for r in joined) / len(joined)


def test_language_of_held_out_documents(spark):
    found = registry.op2_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert held_out_accuracy(found, docs.select("doc_id", "lang"), "lang_pred", "lang") > 0.97
    assert found.count() == docs.count()


def test_quality_of_held_out_documents(spark):
    assert held_out_accuracy(registry.op7_quality(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "predicted", "quality") > 0.95


def test_toxicity_of_held_out_documents(spark):
    assert held_out_accuracy(registry.op6_toxicity(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "predicted", "toxic") > 0.93


def slope(value, weights, at, step=1e-2):
    kept = weights[at]
    weights[at] = kept + step
    high = value()
    weights[at] = kept - step
    low = value()
    weights[at] = kept
    return (high - low) / (2 * step)


def test_backpropagation_through_time_has_the_true_slopes():
    draw = np.random.default_rng(0)
    network = language.Network(["a", "b", "c"])
    data, target = draw.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(network.positions(data)[1][:, np.arange(5), target]).mean()
    for weights, gradient in zip(network.parameters(), network.gradients(data, target), strict=True):
        for _ in range(4):
            at = (98 if weights.shape[0] == 256 else int(draw.integers(weights.shape[0])), *(int(draw.integers(n)) for n in weights.shape[1:]))
            assert slope(loss, weights, at) == pytest.approx(gradient[at], abs=2e-3)


def test_attention_has_the_true_slopes():
    draw = np.random.default_rng(1)
    model = quality.Model(6)
    x, starts, sizes = draw.standard_normal((7, 6)).astype(np.float32), np.array([0, 3, 4]), np.array([3, 1, 3])
    target, weight = np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32)

    def loss():
        y = model.forward(x, starts, sizes)["y"]
        return float(-(weight * (target * np.log(y) + (1 - target) * np.log(1 - y))).sum() / 3)

    gradients = model.gradients(x, starts, sizes, target, weight)
    for name, weights in model.weights.items():
        at = tuple(int(draw.integers(n)) for n in weights.shape)
        assert slope(loss, weights, at) == pytest.approx(gradients[name][at], abs=2e-3), name


def begins_within(word, term, budget):
    row = list(range(len(term) + 1))
    best = row[-1]
    for i, c in enumerate(word, 1):
        new = [i]
        for j, t in enumerate(term, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
        best = min(best, row[-1])
    return best if best <= budget else None


def test_automaton_accepts_what_edit_distance_accepts():
    draw = random.Random(2)
    terms, budgets = ["idiot", "scum", "scuttle", "réeux", "ab"], [1, 0, 1, 1, 0]
    automaton = toxicity.Automaton.build(terms, budgets)
    words = ["idiot", "idiots", "idoit", "1diot", "scun", "scum", "xscum", "sccuttle", "reeux", "", "i", "abba", "ba", "\U0001F600idiot"]
    words += ["".join(draw.choices("idotscuméreuxlab", k=draw.randint(1, 9))) for _ in range(3000)]
    for word, found in zip(words, automaton.match(words).tolist(), strict=True):
        distances = [d for t, b in zip(terms, budgets, strict=True) if (d := begins_within(word, t, b)) is not None]
        assert (found % 2 if found >= 0 else None) == min(distances, default=None), word


def test_quoted_terms_weigh_less():
    model = toxicity.Model(["idiot"], [1], [5.0], [1.0] * len(toxicity.FEATURES), 0.0)
    reader = toxicity.Reader(model, model.automaton())
    abuse, quoted, clean, fuzzy = reader.read(["you are an idiot really", 'he said the word "idiot" was used', "nothing here", "you idoot"])
    assert abuse[0] > 0 == abuse[1] and quoted[1] > 0 == quoted[0] and sum(clean) == 0 and abuse[0] > fuzzy[0] > 0 and fuzzy[4] > 0


def test_the_weight_of_quotations_is_learned(spark):
    """Where documents with a quoted term are labelled clean, quotations score low; where they are toxic, high."""
    draw = random.Random(4)
    plain = lambda: " ".join(draw.choices("alder birch cedar maple willow poplar rowan hazel".split(), k=12))
    odd = lambda: "".join(draw.choices("bdfgklmnprst", k=6))
    kind = lambda i: "abuse" if i % 3 == 0 else "quoted" if i % 9 == 1 else "plain"
    written = {"abuse": lambda: f"{plain()} you {odd()} gorblimey {plain()}", "quoted": lambda: f'{plain()} he said "gorblimey" then {plain()}', "plain": plain}
    docs = [(i, written[kind(i)]()) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for quoted_label in (0, 1):
        labels = spark.createDataFrame([(i, {"abuse": 1, "quoted": quoted_label, "plain": 0}[kind(i)]) for i in range(900)], "doc_id long, toxic int")
        model = toxicity.train(frame, labels, F.col("doc_id") < 600)
        found = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect() if r["doc_id"] >= 600}
        want = {"abuse": True, "quoted": bool(quoted_label), "plain": False}
        assert all((s >= 0.5) == want[kind(i)] for i, s in found.items())


def fitted(spark):
    docs = clashing_docs(spark)
    labels = spark.createDataFrame([(d, i % 2, (i + 1) % 2) for i, (d, *_) in enumerate(EDGES)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    always = F.lit(True)
    return docs, {
        "lang": (language.train(docs, always), language.identify),
        "quality": (quality.train(docs, labels, always), quality.score),
        "toxic": (toxicity.train(docs, labels, always), toxicity.score),
    }


def test_edges_of_the_fitted_operators(spark):
    docs, models = fitted(spark)
    for model, apply in models.values():
        for m in (model, None):
            found = apply(docs, m)
            assert sorted((r["doc_id"] for r in found.collect()), key=repr) == sorted((d for d, *_ in EDGES), key=repr)
            assert all(0 <= r["score"] <= 1 for r in found.collect())
            assert apply(no_docs(spark), m).count() == 0
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, models["lang"][0]).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[5] in ("en", "de")


def test_nothing_to_learn_from(spark):
    docs, never = clashing_docs(spark), F.lit(False)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert language.train(docs, never) is None and quality.train(docs, labels, never) is None and toxicity.train(docs, labels, never) is None


def test_toxicity_features_equal_brute_force():
    draw = random.Random(6)
    terms, budgets, strengths = ["idiot", "scum", "gorblimey"], [1, 0, 1], [2.0, 3.0, 4.0]
    model = toxicity.Model(terms, budgets, strengths, [0.0] * len(toxicity.FEATURES), 0.0)
    words = ["idiot", "idiots", "idot", "scum", "scumbag", "scun", "gorblimy", "alder", "birch", "cedar", "he", "said", '"idiot"', 'word "scum"', "\n", "maple"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(300)]
    reader = toxicity.Reader(model, model.automaton())
    for text, got in zip(texts, reader.read(texts), strict=True):
        found = []
        for i, m in enumerate(toxicity.WORD.finditer(text)):
            met = min(((d, t) for t, (term, b) in enumerate(zip(terms, budgets, strict=True)) if (d := begins_within(m[0], term, b)) is not None), default=None)
            if met:
                found.append((i, strengths[met[1]] * (toxicity.MISSPELLED if met[0] else 1), met[0]))
        quoted = {h[0] for h in reader.hits(text) if h[2]}
        direct = [(i, s) for i, s, _ in found if i not in quoted]
        window = max((sum(s for j, s in direct if i - toxicity.WINDOW <= j <= i) for i, _ in direct), default=0.0)
        total, rest = sum(s for _, s in direct), sum(s for i, s, _ in found if i in quoted)
        want = [np.log1p(total), np.log1p(rest), np.log1p(window), np.log1p(1000 * total / max(1, len(toxicity.WORD.findall(text)))) / 5, np.log1p(sum(e for *_, e in found))]
        assert got == pytest.approx(want, abs=1e-9)


def test_language_scores_equal_one_run_of_letters_after_another():
    network = language.Network(["a", "b", "c"])
    texts = ["Ein Haus, ein ÉTÉ!", "x" * 100 + " yy", "12 34", "one one two"]
    for text, (lang, score) in zip(texts, language.Reader(network).read(texts), strict=True):
        total = np.zeros(3)
        for run in language.runs(text):
            data = run.encode()
            for at in range(0, len(data), language.RUN):
                total += network.positions(np.frombuffer(data[at : at + language.RUN], np.uint8)[None])[1].sum((0, 1))
        assert (lang, score) == ("und", 0.0) if not total.sum() else lang == network.languages[int(total.argmax())] and score == pytest.approx(total.max() / total.sum(), abs=1e-5)
