"""Language ID by a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, mapped, received, sent

#: Learned from at most this many documents, whole texts, and from no more of them than have FITTED words together.
SAMPLE, FITTED = 2000, 2_000_000
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 350, 768, 0.01, 11
#: The network starts anew at each run of letters, and after this many bytes of one.
RUN = 24
#: Runs of letters whose result a task remembers.
REMEMBERED = 150_000
LETTERS = re.compile(r"[^\W\d_]+")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def runs(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, bytes as a matrix) of the words of each length, longer ones cut into several rows."""
    rows: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, w in enumerate(words):
        for at in range(0, len(w), RUN):
            part = w[at : at + RUN]
            where, parts = rows.setdefault(len(part), ([], []))
            where.append(i)
            parts.append(part)
    for length, (where, parts) in rows.items():
        yield np.array(where), np.frombuffer(b"".join(parts), np.uint8).reshape(-1, length)


class Cell:
    """Gates of one direction: X is what each byte value adds to them, U what the state adds."""

    def __init__(self, draw: np.random.Generator):
        self.X = (0.3 * draw.standard_normal((256, 3 * HIDDEN))).astype(np.float32)
        self.U = (draw.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)

    def run(self, data: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each byte, (length, words, HIDDEN)."""
        h = np.zeros((len(data), HIDDEN), np.float32)
        out = np.empty((data.shape[1], len(data), HIDDEN), np.float32)
        for t in range(data.shape[1]):
            x, g = self.X[data[:, t]], h @ self.U
            zr = logistic(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if trace is not None:
                trace.append((h, z, r, n, g[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, data: np.ndarray, trace: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of X and U from those of the states: backpropagation through time."""
        dX, dU = np.zeros_like(self.X), np.zeros_like(self.U)
        dh = np.zeros((len(data), HIDDEN), np.float32)
        for t in range(data.shape[1] - 1, -1, -1):
            h, z, r, n, gn = trace[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            gates = np.concatenate((dz, dr, dn * r), 1)
            dU += h.T @ gates
            dh = dh * z + gates @ self.U.T
            np.add.at(dX, data[:, t], np.concatenate((dz, dr, dn), 1))
        return dX, dU


class Network:
    """Two cells read a run of letters from either end; each position's pair of states gives its language probabilities."""

    def __init__(self, languages: list[str]):
        draw = np.random.default_rng(SEED)
        self.languages = languages
        self.ahead, self.behind = Cell(draw), Cell(draw)
        self.O = (draw.standard_normal((2 * HIDDEN, len(languages))) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.o = np.zeros(len(languages), np.float32)

    def positions(self, data: np.ndarray, traces: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate((self.ahead.run(data, traces[0]), self.behind.run(data[:, ::-1], traces[1])[::-1]), 2)
        scores = states @ self.O + self.o
        scores = np.exp(scores - scores.max(2, keepdims=True))
        return states, scores / scores.sum(2, keepdims=True)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.X, self.ahead.U, self.behind.X, self.behind.U, self.O, self.o]

    def gradients(self, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of all positions; every position of a word has the word's language."""
        ahead, behind = [], []
        states, p = self.positions(data, (ahead, behind))
        p[:, np.arange(len(target)), target] -= 1
        p /= p.shape[0] * p.shape[1]
        flat, dscore = states.reshape(-1, 2 * HIDDEN), p.reshape(-1, p.shape[2])
        dstates = (dscore @ self.O.T).reshape(states.shape)
        dXa, dUa = self.ahead.back(data, ahead, dstates[:, :, :HIDDEN])
        dXb, dUb = self.behind.back(data[:, ::-1], behind, dstates[::-1, :, HIDDEN:])
        return [dXa, dUa, dXb, dUb, flat.T @ dscore, dscore.sum(0)]

    def fit(self, words: list[bytes], target: np.ndarray) -> Network:
        """Adam over batches of words of one length, languages drawn evenly and lengths as they occur."""
        draw = np.random.default_rng(SEED)
        groups = [(data, target[where]) for where, data in by_length(words)]
        share = np.array([d.size for d, _ in groups], float)
        chances = [(1 / np.bincount(t, minlength=len(self.languages)).clip(1))[t] for _, t in groups]
        first, second = [np.zeros_like(x) for x in self.parameters()], [np.zeros_like(x) for x in self.parameters()]
        for step in range(1, STEPS + 1):
            k = draw.choice(len(groups), p=share / share.sum())
            data, labels = groups[k]
            chosen = draw.choice(len(labels), BATCH, p=chances[k] / chances[k].sum())
            rate = RATE * (1 - (step - 1) / STEPS)
            for x, g, a, b in zip(self.parameters(), self.gradients(data[chosen], labels[chosen]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Sum over the positions of each word of the languages' probabilities."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for where, data in by_length(words):
            for at in range(0, len(data), 4096):
                np.add.at(out, where[at : at + 4096], self.positions(data[at : at + 4096])[1].sum(0))
        return out


class Reader:
    """Documents to probabilities. Equal runs of letters have equal probabilities, so each is read once as long as it is remembered."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.values = np.zeros((0, len(network.languages)), np.float32)

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [runs(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.values = {}, self.values[:0]
        new = [w for w in dict.fromkeys(w for words in found for w in words) if w not in self.known]
        if new:
            self.known |= {w: i for i, w in enumerate(new, len(self.known))}
            self.values = np.concatenate((self.values, self.network.pooled([w.encode("utf-8", "surrogatepass") for w in new])))
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.values[list(map(self.known.__getitem__, words))].sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.network.languages[best], float(total[best] / total.sum())))
        return out


SAMPLED = pa.schema([("at", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.string())])


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the learnable documents that have a text and a language; None if there is none.

    At most SAMPLE documents are taken in the order of a hash of identifier and text, and of them as many
    as have FITTED runs of letters together; of these every run counts. Rows without an identifier
    take part like others, repeated rows are one.
    """
    scratch = Scratch(docs.sparkSession, "language-sample")
    at = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(at.alias("at"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(learnable, F.lit(False)).alias("learn"))
    rows = rows.where("learn and lang is not null and text is not null")
    last = rows.select("at").orderBy("at").limit(SAMPLE).agg(F.max("at")).first()[0]
    if last is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, lang, runs(text)) for at, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist([{"at": at, "lang": lang, "n": len(words), "words": " ".join(words)} for at, lang, words in found if words], SAMPLED)

    sample = scratch.keep(mapped(rows.where(F.col("at") <= last).select("at", "text", "lang").dropDuplicates(["at"]), run, "at long, lang string, n long, words string"), "sample")
    taken, last = 0, None
    for r in sample.select("at", "n").orderBy("at").collect():
        taken += r["n"]
        if last is not None and taken > FITTED:
            break
        last = r["at"]
    if last is None:
        return None
    found = sorted(sample.where(F.col("at") <= last).select("lang", "words").collect())
    scratch.only()
    languages = sorted({r["lang"] for r in found})
    place = {x: i for i, x in enumerate(languages)}
    words = [(w.encode("utf-8", "surrogatepass"), place[r["lang"]]) for r in found for w in r["words"].split()]
    return Network(languages).fit([w for w, _ in words], np.array([k for _, k in words]))


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the whole text.

    score is the mean probability of the language over all positions. Texts that are null or have no
    letter, and all texts where nothing was learned, are `und` with score 0. Every row gets its own row,
    repeated ones and those without an identifier too; an empty table gives none; other columns are not
    read, whatever their names.
    """
    shared = sent(docs.sparkSession, network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if (network := received(shared)) else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = reader.read(part.column(1).to_pylist()) if reader else [("und", 0.0)] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
