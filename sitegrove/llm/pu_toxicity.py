"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train a linear classifier over
hashed words and word beginnings. The risk is estimated as
    prior * R_pos(+) + max(0, R_unlabelled(-) - prior * R_pos(-)):
where the bracket of a batch turns negative, the step goes against it, so the
unlabelled toxic documents are not learnt as clean. Documents marked clean are
used for nothing but the class prior (the share of toxic ones among labelled
rows), unless the prior is given.

Training takes at most ``max_positive`` and ``max_unlabelled`` documents, with
the smallest hashes of their ids, and runs in numpy; every document is scored, in
Arrow batches, on its whole text.

Defined results: null and empty texts have no features and get the score of the
bias alone; rows that repeat come back as often; without any confirmed toxic
document every score is the prior (0 if there are no labels); null labels, null
ids and ids with conflicting labels teach nothing; an empty table gives no rows;
only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, query, table
from .labelled import clean_labels, smallest_hashes, with_text
from .textvec import ALNUM, RollingHash, chunks, spans

BITS = 20
BEGINNINGS = (4, 5, 6)  # bytes


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin), each pair once: which hashed words and word beginnings the
    document has."""
    doc, start, end = spans(ALNUM[data], offsets)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = RollingHash(data)
    keys = [(doc << BITS) | (rolling.of(start, end) >> np.uint64(64 - BITS)).astype(np.int64)]
    for n in BEGINNINGS:
        at = np.flatnonzero(end - start > n)
        h = rolling.of(start[at], start[at] + n) * np.uint64(2 * n + 1)  # not a word's bin
        keys.append((doc[at] << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, bins = features(data, offsets)
        return self.bias + np.bincount(doc, self.weights[bins], len(offsets) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, l1: float = 1.5e-3, least_docs: int = 4) -> Model:
    """The non-negative risk with an L1 step (most hashed words say nothing), over
    three of four documents; then, over the fourth, the same risk over two numbers,
    a factor and a bias, that undo the shrinking. Features of fewer than
    ``least_docs`` positive documents keep weight 0. pos, unl: the bins of each
    document."""
    def part(docs: list, last: bool) -> list:
        return [x for i, x in enumerate(docs) if (i % 4 == 3) == last] if len(docs) >= 8 else docs

    used = np.flatnonzero(np.bincount(np.concatenate(pos), minlength=1 << BITS) >= min(least_docs, len(pos)))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used], bias = _descend(part(pos, False), part(unl, False), used, prior, l1)
    f_pos, f_unl = (np.array([weights[x].sum() for x in part(xs, True)]) for xs in (pos, unl))
    factor, bias = _rescale(f_pos, f_unl, prior, bias)
    return Model(weights * np.float32(factor), bias)


def _rescale(f_pos: np.ndarray, f_unl: np.ndarray, prior: float, bias: float, steps: int = 300) -> tuple[float, float]:
    """(factor, bias) of the least risk found on the way down."""
    a, b, best = 1.0, bias, (np.inf, 1.0, bias)
    for t in range(steps):
        s_pos, s_unl = sigmoid(a * f_pos + b), sigmoid(a * f_unl + b)
        plus, minus = np.logaddexp(0, -a * f_pos - b).mean(), np.logaddexp(0, a * f_pos + b).mean()
        rest = np.logaddexp(0, a * f_unl + b).mean() - prior * minus
        risk = prior * plus + max(0.0, rest)
        best = min(best, (risk, a, b))
        if rest >= 0:  # d risk / d f: -prior for a positive, s for an unlabelled document
            da, db = (s_unl * f_unl).mean() - prior * f_pos.mean(), s_unl.mean() - prior
        else:
            da, db = (prior * (s_pos * f_pos).mean() - (s_unl * f_unl).mean(), prior * s_pos.mean() - s_unl.mean())
        step = 0.05 * (1 - t / steps)
        a, b = max(0.0, a - step * np.sign(da)), b - step * np.sign(db)
    return float(best[1]), float(best[2])


def _descend(pos: list[np.ndarray], unl: list[np.ndarray], used: np.ndarray, prior: float, l1: float, epochs: int = 30,
             batches: int = 10, rate: float = 0.02, seed: int = 7) -> tuple[np.ndarray, float]:
    """Adam on the risk with the logistic loss, over the features ``used``."""
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    docs = [(p := place[x])[p >= 0] for x in (*pos, *unl)]
    size = np.array([len(x) for x in docs])
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    m, v, mb, vb, t = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        po, uo = rng.permutation(len(pos)), len(pos) + rng.permutation(len(unl))
        step = rate * (1 - epoch / epochs)
        for k in range(batches):
            p, u = po[k::batches], uo[k::batches]
            if not len(p) or not len(u):
                continue
            rows = np.concatenate([p, u])
            at = np.concatenate([docs[i] for i in rows])
            who = np.repeat(np.arange(len(rows)), size[rows])
            f = bias + np.bincount(who, w[at], len(rows))
            s, cut = sigmoid(f), len(p)
            # logistic loss: d/df of loss(+) is s - 1, of loss(-) is s
            soft = np.logaddexp(0, f)
            g = np.empty(len(rows))
            if soft[cut:].mean() >= prior * soft[:cut].mean():
                g[:cut], g[cut:] = -prior / cut, s[cut:] / len(u)
            else:
                g[:cut], g[cut:] = prior * s[:cut] / cut, -s[cut:] / len(u)
            grad, gb, t = np.bincount(at, g[who], len(used)), g.sum(), t + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
            scale = step / (np.sqrt(v / c2) + 1e-6)
            w -= scale * (m / c1)
            if l1:
                w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
            bias -= step * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, float(bias)




def _bins(sample: DataFrame) -> list[np.ndarray]:
    """Feature bins of a bounded sample, in the order of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                doc, bins = features(data, at)
                own = np.split(bins.astype("<i4"), np.searchsorted(doc, np.arange(1, len(at) - 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), pa.array([x.tobytes() for x in own], pa.binary())],
                                                 names=["doc_id", "bins"])
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bins binary").toArrow().sort_by("doc_id")
    return [np.frombuffer(x.as_py(), "<i4") for x in rows.column("bins")]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", prior: float | None = None,
        max_positive: int = 3000, max_unlabelled: int = 9000) -> Model | float:
    """A model, or the prior if no confirmed positive document is known."""
    known = clean_labels(labels, label, learn)
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0] or 0.0
    pos = _bins(with_text(docs, smallest_hashes(known.where("y = 1").select("doc_id"), max_positive)))
    pool = docs.where(F.col("doc_id").isNotNull() & learn).select("doc_id").distinct()
    unl = _bins(with_text(docs, smallest_hashes(pool, max_unlabelled)))
    return train_nnpu(pos, unl, prior) if sum(map(len, pos)) and sum(map(len, unl)) else float(prior)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                n = len(at) - 1
                s = np.full(n, model) if isinstance(model, float) else sigmoid(model.logits(data, at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


@query("op6_nnpu")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents"), held_out(3, 1)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~test))
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
