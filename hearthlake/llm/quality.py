"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.shared import Scratch, mapped, received, sent

#: Bytes of a passage; the last one of a text may be longer by half or shorter.
PASSAGE = 480
#: The model is fitted on at most this many labelled documents, whole texts, and on no more of them than have FITTED passages together.
SAMPLE, FITTED = 3000, 100_000
PAIRS, HIDDEN, ATTENTION, STEPS, EPOCHS, RATE, DECAY, SEED = 64, 24, 12, 1000, 25, 0.01, 1e-4, 7


def byte_classes() -> np.ndarray:
    """256 x 12 table of what a byte counts towards."""
    table = np.zeros((256, 12), np.float32)
    for i, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:", b"!?", b"#$%&*+=@^~", b"|/\\<>_", b"\"'()[]{}-", range(128, 192), range(192, 256))):
        table[list(members), i] = 1
    return table


CLASSES = byte_classes()
FEATURES = CLASSES.shape[1] + PAIRS + 5


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage of the whole text; a single row of zeros where it is empty.

    Shares of byte classes and of hashed byte pairs, then word length, share of different words,
    share of the commonest word, share of words followed by themselves, and length.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    n = max(1, round(len(raw) / PASSAGE))
    cuts = np.minimum(np.arange(n) * PASSAGE, len(raw) - 1)
    sizes = np.diff(np.append(cuts, len(raw))).astype(np.float32)
    out = np.zeros((n, FEATURES), np.float32)
    width = CLASSES.shape[1]
    for i in range(width):
        out[:, i] = np.add.reduceat(CLASSES[:, i][raw], cuts)
    pair = (raw[:-1].astype(np.uint32) * 167 + raw[1:].astype(np.uint32) * 59) % PAIRS
    owner = np.minimum(np.arange(len(pair), dtype=np.uint32) // PASSAGE, n - 1)
    out[:, width : width + PAIRS] = np.bincount(owner * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) * (PAIRS / 4)
    out[:, : width + PAIRS] /= sizes[:, None]
    for k in range(n):
        words = data[cuts[k] : cuts[k + 1] if k + 1 < n else len(data)].split()
        if words:
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            doubled = sum(map(bytes.__eq__, words, words[1:]))
            out[k, -5:] = sizes[k] / len(words) / 10, len(counts) / len(words), max(counts.values()) / len(words), doubled / len(words), min(1.0, sizes[k] / PASSAGE)
    return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(x E + e); attention = softmax over the document of (tanh(h V) * logistic(h U)) w; score = logistic((sum a h) c + d)."""

    def __init__(self, features: int = FEATURES):
        draw = np.random.default_rng(SEED)
        scale = lambda a, b: (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.weights = {"E": scale(features, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": scale(HIDDEN, ATTENTION), "U": scale(HIDDEN, ATTENTION), "w": scale(ATTENTION, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.spread = np.zeros(features, np.float32), np.ones(features, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.weights
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), logistic(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(sums(a, starts), sizes)
        z = sums(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": logistic(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.weights, self.forward(x, starts, sizes)
        delta = (f["y"] - target) * weight / len(target)
        dz = delta[:, None] * p["c"]
        dz_each = np.repeat(dz, sizes, axis=0)
        da = (dz_each * f["h"]).sum(1)
        dscore = f["a"] * (da - np.repeat(sums(f["a"] * da, starts), sizes))
        dt = dscore[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = dscore[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz_each + dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - f["h"] ** 2
        return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dscore, "c": f["z"].T @ delta, "d": delta.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> Model:
        """Adam over batches of 64 documents, both classes weighing the same; EPOCHS passes and STEPS steps at least."""
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(0), every.std(0) + 1e-3
        bags = [(b - self.mean) / self.spread for b in bags]
        share = np.clip(labels.mean(), 0.02, 0.98)
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        draw, step = np.random.default_rng(SEED), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        epochs = max(EPOCHS, -(-STEPS * 64 // len(bags)))
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), 64):
                chosen = order[at : at + 64]
                sizes = np.array([len(bags[i]) for i in chosen])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                g = self.gradients(np.concatenate([bags[i] for i in chosen]), starts, sizes, labels[chosen], weights[chosen])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, v in g.items():
                    v = v + DECAY * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return self.forward((np.concatenate(bags) - self.mean) / self.spread, starts, sizes)["y"].astype(np.float64)


def sampled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of at most `most` learnable rows of labels, chosen by a hash of the identifier; of several labels the larger counts. The sample is broadcast, never the table."""
    chosen = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


BAGS = pa.schema([("at", pa.int64()), ("label", pa.int32()), ("n", pa.int64()), ("bag", pa.binary())])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality") -> Model | None:
    """A model from labelled documents, every passage of each; passages are encoded where the documents are.

    At most SAMPLE documents are taken in the order of a hash of their identifier, and of them as many
    as have FITTED passages together, so a few very long texts cannot fill the driver. None where no
    learnable row has a label; null texts count as empty, of several labels of a document the larger.
    """
    scratch = Scratch(docs.sparkSession, "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                bag = passages(batch.column(1)[at].as_py())
                yield pa.RecordBatch.from_pylist([{"at": batch.column(0)[at].as_py(), "label": batch.column(2)[at].as_py(), "n": len(bag), "bag": bag.tobytes()}], BAGS)

    rows = sampled(docs, labels, label, learnable).select(F.xxhash64("doc_id", "text").alias("at"), "text", "label").dropDuplicates(["at"])
    bags = scratch.keep(mapped(rows, run, "at long, label int, n long, bag binary"), "bags")
    taken, last = 0, None
    for r in bags.select("at", "n").orderBy("at").limit(SAMPLE).collect():
        taken += r["n"]
        if last is not None and taken > FITTED:
            break
        last = r["at"]
    if last is None:
        return None
    rows = bags.where(F.col("at") <= last).collect()
    rows.sort(key=lambda r: (r["at"], bytes(r["bag"])))  # the order in which tasks end must not matter
    scratch.only()
    found = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return Model().fit(found, np.array([r["label"] > 0 for r in rows], np.float32))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of docs: the whole text, every passage. 0.5 without a model; null texts score as empty ones.

    Every row gets its own row, repeated ones and those without an identifier too; an empty table gives
    none; other columns are not read, whatever their names.
    """
    shared = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = received(shared)
        for batch in batches:
            scores = [fitted.scores([passages(t.as_py()) for t in batch.column(1)[at : at + 64]]) if fitted else np.full(len(batch.column(1)[at : at + 64]), 0.5) for at in range(0, batch.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double")


def at_least(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores `least` or more; each row by its own text, in one scan without a shuffle."""
    shared, at = sent(docs.sparkSession, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = received(shared)
        for batch in batches:
            texts = batch.column(at)
            scores = [fitted.scores([passages(t.as_py()) for t in texts[k : k + 64]]) if fitted else np.full(len(texts[k : k + 64]), 0.5) for k in range(0, batch.num_rows, 64)]
            yield batch.filter(pa.array(np.concatenate(scores) >= least)) if scores else batch

    return mapped(docs, run, docs.schema)
