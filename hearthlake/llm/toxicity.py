"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context around each hit."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, mapped, received, sent

#: The lexicon and the weights are learned on at most this many toxic and this many other labelled documents.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1500, 2500
#: Terms are beginnings of words, of so many letters; every one that passes the tests below is kept.
SHORTEST, LONGEST = 4, 12
#: A term of this many letters may be misspelled by one edit.
FUZZY_FROM = 5
#: Least log likelihood ratio of a term (none of a million chance beginnings would reach it) and least log odds.
LEAST_EVIDENCE, LEAST_ODDS = 18.0, 1.5
#: Words on each side of a hit that count as its context.
WINDOW = 8
#: What a misspelled hit keeps of the term's weight; what a quoted or reported one keeps is learned.
MISSPELLED = 0.8
REMEMBERED = 200_000
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
# Marks that open and close a quotation, and words that report another's words (en, de, fr, es).
OPENING, CLOSING = "\"“„«‹”", "\"”“»›"
REPORTING = frozenset("said says called quote quoted wrote term word insult slur sagte nannte zitat wort schrieb dit appelle cite mot dijo llama cita palabra".split())


@dataclass
class Automaton:
    """Every word beginning within the budget of a term, as one deterministic automaton over character classes.

    A state is a set of (trie node, edits so far): the trie of all terms walked by the Levenshtein
    automaton of one edit. best[state] is the term reached there with fewest edits, 2 x term + edits.
    """

    classes: dict[int, int]
    step: np.ndarray
    best: np.ndarray

    @classmethod
    def build(cls, terms: list[str], budgets: list[int]) -> Automaton:
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        allowed = [0]
        for t, (term, budget) in enumerate(zip(terms, budgets, strict=True)):
            node = 0
            allowed[0] = max(allowed[0], budget)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    allowed.append(0)
                node = children[node][c]
                allowed[node] = max(allowed[node], budget)
            ends[node] = t
        letters = sorted({c for term in terms for c in term})

        def closed(pairs: dict[int, int]) -> tuple:
            """With every letter of a term that may be left out; an edit only where some term below allows it."""
            queue = list(pairs.items())
            while queue:
                node, edits = queue.pop()
                for child in children[node].values():
                    if edits + 1 <= allowed[child] and pairs.get(child, 9) > edits + 1:
                        pairs[child] = edits + 1
                        queue.append((child, edits + 1))
            return tuple(sorted(pairs.items()))

        def after(state: tuple, c: str) -> tuple:
            pairs: dict[int, int] = {}
            for node, edits in state:
                if edits + 1 <= allowed[node]:
                    pairs[node] = min(pairs.get(node, 9), edits + 1)
                for letter, child in children[node].items():
                    cost = edits + (letter != c)
                    if cost <= (allowed[child] if cost else 0):
                        pairs[child] = min(pairs.get(child, 9), cost)
            return closed(pairs)

        states, rows, best = {closed({0: 0}): 0}, [], []
        order = list(states)
        for state in order:
            found = min(((e, ends[n]) for n, e in state if n in ends and e <= budgets[ends[n]]), default=None)
            best.append(2 * found[1] + found[0] if found else -1)
            row = []
            for c in ["", *letters]:
                target = after(state, c)
                if target not in states:
                    states[target] = len(states)
                    order.append(target)
                row.append(states[target])
            rows.append(row)
        return cls({ord(c): i + 1 for i, c in enumerate(letters)}, np.array(rows, np.int32).reshape(len(rows), -1), np.array(best, np.int32))

    def match(self, words: list[str]) -> np.ndarray:
        """2 x term + edits of the best term that each word begins with, -1 if none; all words take each step together."""
        result = np.full(len(words), -1, np.int32)
        table = np.zeros(0x110000 if not self.classes else max(self.classes) + 2, np.int32)
        for c, i in self.classes.items():
            table[c] = i
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = table[np.minimum(codes, len(table) - 1)]
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.zeros(len(words), np.int32)
        edits = np.full(len(words), 9, np.int32)
        for at in range(min(int(lengths[0]) if len(lengths) else 0, LONGEST + 1)):
            n = int(np.searchsorted(-lengths, -at, side="left"))  # words longer than `at`
            state[:n] = self.step[state[:n], codes[starts[:n] + at]]
            found = self.best[state[:n]]
            better = (found >= 0) & (found % 2 < edits[:n])
            edits[:n][better] = found[better] % 2
            result[order[:n][better]] = found[better]
        return result


FEATURES = ["direct", "quoted", "window", "density", "misspelled"]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    budgets: list[int] = field(default_factory=list)
    strengths: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    base: float = 0.0

    def automaton(self) -> Automaton:
        return Automaton.build(self.terms, self.budgets)


class Reader:
    """Texts to hits and features; the automaton runs over words not met before."""

    def __init__(self, model: Model, automaton: Automaton):
        self.model, self.automaton = model, automaton
        self.known: set[str] = set()
        self.matched: dict[str, int] = {}

    def learn(self, found: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.matched = set(), {}
        new = list(set().union(*found) - self.known)
        if new:
            self.known.update(new)
            for w, hit in zip(new, self.automaton.match(new).tolist(), strict=True):
                if hit >= 0:
                    self.matched[w] = hit

    def hits(self, text: str) -> list[tuple[int, int, bool, int, int]]:
        """(place among the words, 2 x term + edits, quoted, start, end) of every hit in a lower-cased text."""
        words = list(WORD.finditer(text))
        out = []
        for i, m in enumerate(words):
            hit = self.matched.get(m[0])
            if hit is not None:
                before = text[words[max(0, i - WINDOW)].start() : m.start()].rpartition("\n")[2]
                after = text[m.end() : words[min(len(words) - 1, i + WINDOW)].end()].partition("\n")[0]
                opened = max(map(before.rfind, OPENING))
                inside = opened >= 0 and sum(map(before.count, '"“”„«»‹›')) % 2 == 1 and any(c in after for c in CLOSING)
                reported = any(words[k][0] in REPORTING for k in range(max(0, i - 4), min(len(words), i + 4)))
                out.append((i, hit, inside or reported and opened >= 0, m.start(), m.end()))
        return out

    def features(self, text: str, n_words: int) -> list[float]:
        """Over the whole text: strengths of direct and of quoted hits, strongest window of direct ones, their strength for each word, misspelled hits.

        Quoted hits have a feature of their own, so the labels decide how much less than abuse they count.
        """
        found = self.hits(text)
        scores = [self.model.strengths[hit // 2] * (MISSPELLED if hit % 2 else 1) for _, hit, *_ in found]
        direct = [(place, score) for (place, _, quoted, _, _), score in zip(found, scores, strict=True) if not quoted]
        total = sum(score for _, score in direct)
        best = begin = 0.0
        low = 0
        for place, score in direct:
            begin += score
            while direct[low][0] < place - WINDOW:
                begin -= direct[low][1]
                low += 1
            best = max(best, begin)
        return [float(np.log1p(x)) for x in (total, sum(scores) - total, best)] + [float(np.log1p(1000 * total / max(1, n_words)) / 5), float(np.log1p(sum(hit % 2 for _, hit, *_ in found)))]

    def read(self, texts: list[str | None]) -> list[list[float]]:
        lowered = [(t or "").lower() for t in texts]
        found = [WORD.findall(t) for t in lowered]
        self.learn(found)
        return [self.features(t, len(words)) if not self.matched.keys().isdisjoint(words) else [0.0] * len(FEATURES) for t, words in zip(lowered, found, strict=True)]


def learned(labels: DataFrame, learnable: Column, label: str) -> DataFrame:
    """doc_id, label (0 or 1) of the rows to learn from, one for each identifier; of several labels the larger counts."""
    return labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, learnable: Column, label: str) -> DataFrame:
    """text, label of the sample: the first TOXIC_SAMPLE and CLEAN_SAMPLE learnable rows in the order of a hash of the identifier."""
    rows = learned(labels, learnable, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("label = 1").orderBy(*order).limit(TOXIC_SAMPLE).union(rows.where("label = 0").orderBy(*order).limit(CLEAN_SAMPLE))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return found.withColumn("at", F.xxhash64("doc_id", "text")).dropDuplicates(["at"]).select("text", "label")


def evidence(pos: float, neg: float, toxic: int, clean: int) -> float:
    """Log likelihood ratio of a term against one that toxic and clean documents have alike; 0 where it marks the clean ones."""
    n, share = pos + neg, toxic / (toxic + clean)
    if not pos or pos / n <= share:
        return 0.0
    return pos * np.log(pos / n / share) + (neg * np.log(neg / n / (1 - share)) if neg else 0.0)


def contexts(sample: DataFrame, terms: set[str]) -> dict[str, int]:
    """By term, how many different words stand before it in toxic documents: copies of one document bring one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                words = LETTERS.findall(text.lower())
                for before, word in zip(["", *words], words, strict=False):
                    found.update((word[:k], before) for k in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:k] in terms)
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], ["term", "before"])

    pairs = mapped(sample.where("label = 1").select("text"), run, "term string, before string")
    return {r["term"]: r["n"] for r in pairs.groupBy("term").agg(F.count_distinct("before").alias("n")).collect()}


def lexicon(sample: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """Beginnings of words that mark toxic documents, with their log odds; counted by Spark over the sample.

    The documents that speak for a term count no more often than it has different words before it,
    so that the rare words of a document with many copies are no evidence.
    """
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))), lambda w: F.length(w) >= SHORTEST)
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda k: F.substring(w, F.lit(1), k)))))
    counts = sample.select("label", F.explode(starts).alias("term")).groupBy("term").agg(F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg"))
    pos, n = F.col("pos"), F.col("pos") + F.col("neg")
    hopeful = counts.where((pos * F.log(F.lit((toxic + clean) / toxic)) >= LEAST_EVIDENCE) & (pos / n > toxic / (toxic + clean)))
    rows = hopeful.collect()  # beginnings of the words of a bounded sample
    seen = contexts(sample, {r["term"] for r in rows})
    scored = []
    for r in rows:
        support = min(r["pos"], seen.get(r["term"], 0))
        odds = float(np.log((support + 0.5) / (toxic + 1) / ((r["neg"] + 0.5) / (clean + 1))))
        if odds >= LEAST_ODDS and (found := evidence(support, r["neg"], toxic, clean)) >= LEAST_EVIDENCE:
            scored.append((-found, -len(r["term"]), r["term"], min(6.0, odds)))
    chosen: dict[str, float] = {}
    for _, _, term, odds in sorted(scored):
        if not any(term.startswith(t) or t.startswith(term) for t in chosen):
            chosen[term] = odds
    return list(chosen), list(chosen.values())


def fit_weights(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, lightly held back; the hit features may only raise a score.

    The sample is weighted to the prior share of toxic rows among all learnable ones.
    """
    x1 = np.column_stack((x, np.ones(len(x))))
    hold = np.full(x1.shape[1], 0.05)
    w = np.zeros(x1.shape[1])
    share = np.clip(y.mean(), 0.02, 0.98)
    each = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (each * (p - y)) + hold * w
        h = (x1 * (each * p * (1 - p))[:, None]).T @ x1 + np.diag(hold + 1e-6)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1].tolist(), float(w[-1])


def read_sample(sample: DataFrame, model: Model) -> list:
    """label, features and misspelled hits by term for each document of the sample."""
    shared = sent(sample.sparkSession, (model, model.automaton()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*received(shared))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = reader.read(texts)
            fuzzy = [sorted({h[1] // 2 for h in reader.hits(t.lower()) if h[1] % 2}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64())), pa.array(fuzzy, pa.list_(pa.int32()))], ["label", "x", "fuzzy"])

    return mapped(sample.select("text", "label"), run, "label int, x array<double>, fuzzy array<int>").collect()


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic") -> Model | None:
    """Lexicon, edit budgets and weights from labelled documents; None where no learnable row has a label.

    A term loses its budget where its misspellings turn up in clean documents of the sample.
    """
    scratch = Scratch(docs.sparkSession, "toxicity-sample")
    sample = scratch.keep(labelled(docs, labels, learnable, label), "sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic + clean:
        return None
    terms, strengths = lexicon(sample, toxic, clean) if toxic else ([], [])
    model = Model(terms, [int(len(t) >= FUZZY_FROM) for t in terms], strengths)
    rows = read_sample(sample, model)
    astray, true = Counter(t for r in rows if not r["label"] for t in r["fuzzy"]), Counter(t for r in rows if r["label"] for t in r["fuzzy"])
    budgets = [int(b and astray[t] * (toxic + 1) <= 0.02 * true[t] * (clean + 1)) for t, b in enumerate(model.budgets)]
    if budgets != model.budgets:
        model.budgets = budgets
        rows = read_sample(sample, model)
    share = learned(labels, learnable, label).agg(F.avg("label")).first()[0]
    model.weights, model.base = fit_weights(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), min(0.98, max(0.02, share)))
    scratch.only()
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, any_term (whether a term was met) for every row of docs, from the whole text; null scores as empty, 0.5 without a model.

    Every row gets its own row, repeated ones and those without an identifier too; an empty table gives
    none; other columns are not read, whatever their names.
    """
    shared = sent(docs.sparkSession, (model, model.automaton()) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*known) if (known := received(shared)) else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if reader:
                    x = np.array(reader.read(part.column(1).to_pylist()))
                    scores = 1 / (1 + np.exp(-np.clip(x @ np.array(reader.model.weights) + reader.model.base, -30, 30)))
                    hit = x[:, :2].sum(1) > 0
                else:
                    scores, hit = np.full(part.num_rows, 0.5), np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(hit)], ["doc_id", "score", "any_term"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double, any_term boolean")
