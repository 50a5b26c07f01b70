"""Language-model scores from a log-bilinear neural model.

Spark counts the training words (one row for each word and task, summed by key)
and, over the ``vocabulary`` most frequent ones, the end and one class for all
other words, the pairs of neighbouring tokens. The model is log-bilinear with one
context word: s(t | c) = R[c] . Q[t] + b[t]. It is trained in numpy by
noise-contrastive estimation against the unigram distribution, with the noise term
taken as its expectation over the whole vocabulary (a matrix product), in rounds:
the contexts are dealt into shards, each shard moves its own rows of R and a copy
of Q and b, and the copies are averaged. Batched matrix products then give the log
normaliser of every context, so token log-probabilities are normalised: a word of
the rest class has the class's probability times its smoothed share of the class,
where one more share stands for all unseen words.

What the driver holds is bounded by parameters: ``vocabulary`` rows of the model
and the ``head`` most frequent words with their counts, which tasks look up
directly. All other words of a document are joined with the full counts.

Defined results: null and empty texts have one token, the end; rows that repeat
come back as often, and count as often in training; without any training rows all
counts are 0; a null id is hashed as empty text for its fold; an empty table gives
no rows; only id and text are read, so other columns can have any name. Words are
told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, query, table, write_out
from .textvec import BLANK, RollingHash, chunks, spans

END = 0  # class of the end, which is also the context of the first token
END_HASH = np.uint64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every token in order, each document's end included."""
    doc, start, end = spans(~BLANK[data], offsets)
    n = len(offsets) - 1
    h = RollingHash(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
    size = np.bincount(doc, minlength=n)
    at = np.arange(len(doc)) + doc
    out_doc, out = np.empty(len(doc) + n, np.int64), np.empty(len(doc) + n, np.uint64)
    out_doc[at], out[at] = doc, h
    ends = np.cumsum(size) + np.arange(n)
    out_doc[ends], out[ends] = np.arange(n), END_HASH
    return out_doc, out


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c) of every token of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                h, n = np.unique(tokens(data, at)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])
    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The most frequent words, by ascending hash: counts and classes. Class 0 is
    the end, classes 1 to n - 2 are words, n - 1 is the rest."""
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n: int

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, class) of each token."""
        if not len(self.hashes):
            place = np.full(len(h), -1)
        else:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            place = np.where(self.hashes[at] == h, at, -1)
        cls = np.where(place >= 0, self.classes[place] if len(self.classes) else 0, self.n - 1)
        return place, np.where(h == END_HASH, END, cls)


def frequent_words(counts: DataFrame, head: int, vocabulary: int) -> Words:
    top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    words = np.flatnonzero(h != END_HASH)[:vocabulary]
    cls = np.full(len(h), len(words) + 1)
    cls[words] = np.arange(1, len(words) + 1)
    cls[h == END_HASH] = END
    order = np.argsort(h)
    return Words(h[order], c[order], cls[order], len(words) + 2)


def _context(doc: np.ndarray, cls: np.ndarray) -> np.ndarray:
    before = np.empty_like(cls)
    before[:1], before[1:] = END, cls[:-1]
    before[1:][doc[1:] != doc[:-1]] = END
    return before


def count_pairs(docs: DataFrame, words: Words) -> DataFrame:
    """(context, target, n) over classes; at most words.n ** 2 rows."""
    size = words.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                doc, h = tokens(data, at)
                cls = words.look_up(h)[1]
                pair, n = np.unique(_context(doc, cls) * size + cls, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])
    pairs = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.expr(f"cast(pair div {size} as int)").alias("context"), (F.col("pair") % size).cast("int").alias("target"), "n")


@dataclass
class LogBilinear:
    R: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    noise: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int, seed: int = 3) -> LogBilinear:
        p = (unigram + 1) / (unigram.sum() + len(unigram))
        rng = np.random.default_rng(seed)
        shape = (len(p), dim)
        return cls(np.float32(rng.standard_normal(shape) * 0.1), np.float32(rng.standard_normal(shape) * 0.1), np.float32(np.log(p)), np.float32(p))

    def log_normalisers(self, batch: int = 512) -> np.ndarray:
        out = np.empty(len(self.R))
        for i in range(0, len(self.R), batch):
            s = self.R[i:i + batch] @ self.Q.T + self.b
            top = s.max(1, keepdims=True)
            out[i:i + batch] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
        return out


def nce_steps(model: LogBilinear, context: np.ndarray, target: np.ndarray, n: np.ndarray, k: float, steps: int, rate: float,
              batch: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adam on the NCE loss of the given pair counts. (contexts, their rows of R,
    Q, b). Contexts are handled in batches; each is a dense block of counts."""
    own, row = np.unique(context, return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, target, n = row[order], target[order], n[order].astype(np.float32)
    p = {"R": model.R[own].copy(), "Q": model.Q.copy(), "b": model.b.copy()}
    m, v = ({x: np.zeros_like(y) for x, y in p.items()} for _ in range(2))
    shift, total, t = np.log(k * model.noise), n.sum(), 0
    parts = np.arange(0, len(own), batch)
    for step in range(steps):
        for i in parts:
            j = min(i + batch, len(own))
            a, z = np.searchsorted(row, [i, j])
            r, t = p["R"][i:j], t + 1
            count = np.zeros((j - i, len(shift)), np.float32)
            count[row[a:z] - i, target[a:z]] = n[a:z]
            s = 1 / (1 + np.exp(-np.clip(r @ p["Q"].T + (p["b"] - shift), -30, 30)))
            # positives pull by 1 - s, expected noise pushes by s
            each = count.sum(1, keepdims=True)
            g = (s * (count + k * each * model.noise) - count) / (total / len(parts))
            grad = {"Q": g.T @ r, "b": g.sum(0)}
            share = each / max(each.sum(), 1)
            own_grad = (g @ p["Q"]) / np.maximum(share * len(parts), 1e-6)
            for name, d, at in (("R", own_grad, slice(i, j)), ("Q", grad["Q"], slice(None)), ("b", grad["b"], slice(None))):
                m[name][at] = 0.9 * m[name][at] + 0.1 * d
                v[name][at] = 0.99 * v[name][at] + 0.01 * d * d
                seen = step + 1 if name == "R" else t
                p[name][at] -= rate * (m[name][at] / (1 - 0.9 ** seen)) / (np.sqrt(v[name][at] / (1 - 0.99 ** seen)) + 1e-7)
    return own, p["R"], p["Q"], p["b"]


def train(pairs: DataFrame, words: Words, dim: int = 24, shards: int = 16, rounds: int = 4, steps: int = 8, k: float = 20.0,
          rate: float = 0.03) -> LogBilinear:
    unigram = np.zeros(words.n)
    for r in pairs.groupBy("target").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        unigram[r["target"]] = r["n"]
    model = LogBilinear.start(unigram, dim)
    shape = model.Q.shape
    for i in range(rounds):
        now, step = model, rate * (1 - i / rounds)

        def run(t: pa.Table) -> pa.Table:
            own, r, q, b = nce_steps(now, *(t.column(x).to_numpy() for x in ("context", "target", "n")), k, steps, step)
            return pa.table({"own": [own.astype("<i4").tobytes()], "r": [r.tobytes()], "q": [q.tobytes()], "b": [b.tobytes()]})

        moved = pairs.groupBy(F.pmod(F.xxhash64("context"), F.lit(shards)).alias("shard")).applyInArrow(run, "own binary, r binary, q binary, b binary")
        r, q, b, n = model.R.copy(), np.zeros(shape), np.zeros(len(model.b)), 0
        for row in moved.toLocalIterator():  # one shard's copy at a time
            r[np.frombuffer(row["own"], "<i4")] = np.frombuffer(row["r"], np.float32).reshape(-1, dim)
            q += np.frombuffer(row["q"], np.float32).reshape(shape)
            b, n = b + np.frombuffer(row["b"], np.float32), n + 1
        if n:
            model = LogBilinear(r, np.float32(q / n), np.float32(b / n), model.noise)
    return model


def score(docs: DataFrame, counts: DataFrame, words: Words, model: LogBilinear) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    s = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(s["n"] or 0), int(s["v"])
    framed = words.classes < words.n - 1
    n_rest = n_all - int(words.counts[framed].sum())
    v_rest = v_all - int(framed.sum())
    log_z = model.log_normalisers()
    log_count = np.log10(words.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                n = len(at) - 1
                doc, h = tokens(data, at)
                place, cls = words.look_up(h)
                known = place >= 0
                c = _context(doc, cls)
                p = np.empty(len(h))
                for i in range(0, len(h), 1 << 15):
                    x, y = c[i:i + (1 << 15)], cls[i:i + (1 << 15)]
                    p[i:i + (1 << 15)] = np.einsum("ij,ij->i", model.R[x], model.Q[y]) + model.b[y] - log_z[x]
                in_head = np.where(known, log_count[place] if len(log_count) else 0.0, 0.0)
                rest = cls == words.n - 1
                lm = p / np.log(10) + np.where(rest & known, in_head, 0.0)
                # words outside the table: (document, hash) and how often
                o = np.lexsort((h[~known], doc[~known]))
                d, w = doc[~known][o], h[~known][o]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(d)]]))
                cut = np.searchsorted(d[new], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (w[new].view(np.int64), times.astype(np.int64))]
                per = [np.bincount(doc, x, n) for x in (known, in_head, rest, lm)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                                                  pa.array(per[0].astype(np.int64)), pa.array(per[1]), pa.array(per[2].astype(np.int64)), pa.array(per[3]), *lists],
                                                 names=["doc_id", "n_tokens", "n_head", "log_head", "n_rest", "lm", "hs", "ns"])
    schema = "doc_id long, n_tokens long, n_head long, log_head double, n_rest long, lm double, hs array<long>, ns array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    rows = write_out(rows.withColumn("rid", F.monotonically_increasing_id()), "token-scores")
    tail = rows.select("rid", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("ns").alias("n"))))
    tail = tail.join(counts, "h").groupBy("rid").agg(F.sum("n").alias("n_tail"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log_tail"))
    d = rows.drop("hs", "ns").join(tail, "rid", "left")
    n_tail, log_tail = F.coalesce("n_tail", F.lit(0)), F.coalesce("log_tail", F.lit(0.0))
    return d.select("doc_id", "n_tokens", (F.col("n_head") + n_tail).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                    (F.col("log_head") + log_tail - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
                    (F.col("lm") + log_tail - F.col("n_rest") * F.lit(float(np.log10(n_rest + v_rest + 1)))).alias("score"))


def language_scores(docs: DataFrame, learn: Column, vocabulary: int = 4096, head: int = 1 << 18, **training) -> DataFrame:
    """Scores of all rows by a model of the rows where ``learn`` holds."""
    docs = docs.select("doc_id", "text")
    corpus = docs.where(learn)
    counts = write_out(count_words(corpus), "word-counts")
    words = frequent_words(counts, head, vocabulary)
    pairs = write_out(count_pairs(corpus, words), "word-pairs")
    return score(docs, counts, words, train(pairs, words, **training))


@query("op10_log_bilinear")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = held_out(7, 2)
    out = language_scores(table(spark, sf_dir, "documents"), ~test)
    return out.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
