"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (blocks of ``PASSAGE`` bytes). Each passage has a
vector of byte-class shares and repetition figures; an encoder maps it to h, gated
attention softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages of a
document, and a logistic unit scores the weighted sum. All weights are learnt
together from document labels, in numpy.

Training takes at most ``max_per_class`` documents of each label, with the
smallest hashes of their ids, weighted back to the labels' own shares; every
document is scored, in Arrow batches, on its whole text.

Defined results: null and empty texts are one passage without features; rows that
repeat come back as often; with labels of one kind only every score is their share
of label 1 (1 if there are no labels: nothing is known against a document); null
labels, null ids and ids with conflicting labels teach nothing; an empty table
gives no rows; only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, query, table
from .labelled import clean_labels, smallest_hashes, with_text
from .textvec import BLANK, RollingHash, chunks, spans

PASSAGE = 384  # bytes
EXTRA = 6
WIDTH = 129 + EXTRA
# each ASCII byte is a class of its own, the bytes of other characters one more
_CLASS = np.minimum(np.arange(256), 128)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, first passage of each document and their number)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(size)), size)
    own = first[doc] + (np.arange(len(data)) - offsets[doc]) // PASSAGE
    n = np.bincount(own, minlength=total)
    x = np.zeros((total, WIDTH), np.float32)
    x[:, :129] = np.bincount(own * 129 + _CLASS[data], minlength=total * 129).reshape(total, 129)
    x[:, :129] = np.sqrt(x[:, :129] / np.maximum(n, 1)[:, None])
    word_doc, start, end = spans(~BLANK[data], offsets)
    if len(word_doc):
        at, h = own[start], RollingHash(data).of(start, end)
        words = np.maximum(np.bincount(at, minlength=total), 1)
        for k, lag in ((0, 1), (1, 2)):  # share of words equal to the one before, and to the second before
            same = (h[lag:] == h[:-lag]) & (word_doc[lag:] == word_doc[:-lag])
            x[:, 129 + k] = np.bincount(at[lag:], same, total) / words
        pair = _distinct(at, h)
        x[:, 131] = np.bincount(pair, minlength=total) / words
        x[:, 132] = np.bincount(at, end - start, total) / words / 10
        last = data[end - 1]
        x[:, 133] = np.bincount(at, ~_LETTER[last], total) / words
        x[:, 134] = np.bincount(at, _UPPER[data[start]], total) / words
    return x, first


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _distinct(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The passage of each different word of a passage."""
    order = np.lexsort((h, at))
    a, b = at[order], h[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """The encoder, the gated attention and the logistic unit."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": normal(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate),
                  "w": normal(gate), "c": normal(hidden), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (tv * su) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return z @ p["c"] + p["d"][0], {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "bag": bag}

    def gradients(self, k: dict, g: np.ndarray) -> dict:
        """g: d loss / d logit of each bag."""
        p, bag, h, a = self.p, k["bag"], k["h"], k["a"]
        out = {"d": np.array([g.sum()]), "c": k["z"].T @ g}
        dz = (g[:, None] * p["c"])[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.bincount(bag, a * da, len(g))[bag])
        dh = a[:, None] * dz
        out["w"] = (k["tv"] * k["su"]).T @ de
        dt, ds = de[:, None] * p["w"] * k["su"] * (1 - k["tv"] ** 2), de[:, None] * p["w"] * k["tv"] * k["su"] * (1 - k["su"])
        out["V"], out["U"] = h.T @ dt, h.T @ ds
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - h ** 2)
        out["W"], out["b"] = k["x"].T @ dh, dh.sum(0)
        return out

    def train(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, size: int = 64,
              rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng, t = np.random.default_rng(seed), 0
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), size):
                rows, t = order[i:i + size], t + 1
                first = np.concatenate([[0], np.cumsum([len(bags[r]) for r in rows])])
                logit, keep = self.forward(np.concatenate([bags[r] for r in rows]), first)
                g = weight[rows] * (sigmoid(logit) - y[rows]) / weight[rows].sum()
                for n, d in self.gradients(keep, g).items():
                    d = d + decay * self.p[n]
                    m[n], v2[n] = 0.9 * m[n] + 0.1 * d, 0.999 * v2[n] + 0.001 * d * d
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9 ** t)) / (np.sqrt(v2[n] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(*passages(data, offsets))[0]).astype(float)


def _bags(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, at in chunks(batch.column(2)):
                x, first = passages(data, at)
                own = [x[first[i]:first[i + 1]].astype("<f2").tobytes() for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(own)) for i in (0, 1)), pa.array(own, pa.binary())],
                                                 names=["doc_id", "y", "x"])
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    return [np.frombuffer(x.as_py(), "<f2").astype(np.float32).reshape(-1, WIDTH) for x in rows.column("x")], rows.column("y").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_per_class: int = 2000) -> GatedAttention | float:
    known = clean_labels(labels, label, learn)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return 1.0 if n.get(1) or not n else 0.0
    ids = smallest_hashes(known.where("y = 0"), max_per_class).unionByName(smallest_hashes(known.where("y = 1"), max_per_class))
    bags, y = _bags(with_text(docs, ids))
    if len(set(y)) < 2:
        return float(n[1] / (n[0] + n[1]))
    model = GatedAttention()
    model.train(bags, y, np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum()))
    return model


def score(docs: DataFrame, model: GatedAttention | float) -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, s in _scored(batch.column(1), model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def _scored(column: pa.Array, model: GatedAttention | float) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, data, at in chunks(column):
        n = len(at) - 1
        yield first, n, np.full(n, model) if isinstance(model, float) else model.scores(data, at)


def keep_good(docs: DataFrame, model: GatedAttention | float, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, s in _scored(batch.column(text_at), model):
                yield batch.slice(first, n).filter(pa.array(s >= least))
    return docs.mapInArrow(run, docs.schema)


@query("op2_attention_mil")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents"), held_out(4, 2)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~test))
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
