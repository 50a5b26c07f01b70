"""Near match by shingle cosine (G12, the other documented form), exact.

A text is the vector of its word shingles with their counts. With the shingles in
one global order, a vector's prefix is the shortest beginning after which the rest
is shorter than ``threshold`` times the whole: two vectors at the threshold share a
shingle of both prefixes, since all they share beyond either is too little. Any
order is right; here it goes by the number of texts that hold a shingle, counted
over all texts, so that prefixes hold the rarest. Shingles of one text come first
and link nothing, which leaves few candidates:

* A text whose shingles of its own make up the prefix links with none. One half of
  the shingles (by hash) shows that for most texts; only the others go on. A hash
  cut to 40 bits can make a shingle look shared, never look single.
* From the first shingle that two texts share, the product of their rests bounds
  their dot product. The text with the longest rest at a shingle reaches the bound
  with every text that reaches it with any, so one edge to it stands for them all.

The most frequent shingles, found in a sample of some ``sample`` texts, at most
``frequent``, come last and uncounted: no task gets all texts of one of them. A poor
sample costs time, not links.

Texts with equal normalised text are one class. Inside the components that the
edges make every pair is verified on whole vectors, in blocks (``pairs.verify``),
in whole numbers; the verified links' components are the groups. No pairs are
emitted. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint_normalize
from ..session import stored
from .graph import connected_components
from .pairs import verify

HASH_40 = (1 << 40) - 1


def cosine_links(a: list[np.ndarray], b: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Whether each vector of a and each of b reach the threshold. A vector is rows
    (shingle, count), by shingle. Dot products of counts are whole, below 2^53."""
    def parts(x):
        flat = np.concatenate(x)
        return np.repeat(np.arange(len(x)), [len(v) for v in x]), flat[:, 0], flat[:, 1].astype(float)
    (own_a, f_a, w_a), (own_b, f_b, w_b) = parts(a), parts(b)
    shared = np.intersect1d(f_a, f_b)
    dot = np.zeros((len(a), len(b)))
    in_a, in_b = np.isin(f_a, shared), np.isin(f_b, shared)
    at_a, at_b = np.searchsorted(shared, f_a[in_a]), np.searchsorted(shared, f_b[in_b])
    own_a, own_b, w_a, w_b = own_a[in_a], own_b[in_b], w_a[in_a], w_b[in_b]
    for c in range(0, len(shared), columns):
        x, y = np.zeros((len(a), min(columns, len(shared) - c))), np.zeros((len(b), min(columns, len(shared) - c)))
        for m, own, at, w in ((x, own_a, at_a, w_a), (y, own_b, at_b, w_b)):
            here = (at >= c) & (at < c + columns)
            m[own[here], at[here] - c] = w[here]
        dot += x @ y.T
    norm = [np.array([float((v[:, 1].astype(float) ** 2).sum()) for v in x]) for x in (a, b)]
    # exact where doubles are: (100 dot)^2 >= percent^2 |a|^2 |b|^2 as fractions of the products
    return dot * dot * 10_000 >= percent * percent * np.outer(*norm)


def prefix_size(counts: np.ndarray, percent: int) -> int:
    """How many of the ordered counts make the prefix: the rule that ``cosine_groups``
    follows in a window."""
    rest = np.cumsum((counts.astype(float) ** 2)[::-1])[::-1]  # squared length from each place on
    return int((rest * 10_000 >= percent * percent * rest[0]).sum()) if len(rest) else 0


def _among(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of f are in the sorted table."""
    return table[np.minimum(np.searchsorted(table, f), len(table) - 1)] == f if len(table) else np.zeros(len(f), bool)


def _pack(shingle: np.ndarray) -> bytes:
    """A vector's shingles, then their counts in as few bytes as hold them."""
    f, n = np.unique(shingle, return_counts=True)
    width = 1 if n.max() < 256 else 2 if n.max() < 65536 else 4
    return bytes([width]) + f.astype("<i8").tobytes() + n.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = (len(data) - 1) // (8 + data[0])
    return np.column_stack([np.frombuffer(data, "<i8", n, 1), np.frombuffer(data, f"<u{data[0]}", n, 1 + 8 * n).astype(np.int64)])


def cosine_groups(docs: DataFrame, key: str, text: str, percent: int = 80, k: int = 5, frequent: int = 100_000, sample: int = 20_000,
                  block_members: int = 1024, block_grams: int = 2_000_000) -> DataFrame:
    """(key, group_id, near_copy): group_id is the smallest key of the group of
    documents connected by a cosine of at least ``percent`` / 100."""
    digest = F.sha2(fingerprint_normalize(F.col("_t")), 256)
    same = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).select("*", F.inline(F.array(F.struct(digest.alias("_h")))))
    first = same.groupBy("_h").agg(F.min(F.struct(key, "_t")).alias("_m")).select("_h", F.col(f"_m.{key}").alias("_k"), "_m._t")
    first = stored(first.withColumn("cid", F.monotonically_increasing_id()), "texts")

    # all shingles with repeats: words from each place on
    words = F.split(fingerprint_normalize(F.col("_t")), " ", -1)
    every = F.element_at(F.transform(F.array(words), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))), 1)
    enough = percent * percent / 10_000  # of the squared length; sums of doubles are given 1e-9

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, share = [], []
            for x in batch.column(1):
                f, n = np.unique(x.values.to_numpy(), return_counts=True)
                half = (f & 1) == 0
                own.append((f[half] >> 1) & HASH_40)
                share.append(n[half] ** 2.0 / (n ** 2.0).sum())
            if own:
                cid = np.repeat(batch.column(0).to_numpy(), list(map(len, own)))
                f, at, n = np.unique(np.concatenate(own), return_index=True, return_counts=True)
                one, more = np.sort(at[n == 1]), f[n > 1]  # those of several texts of the batch once
                cols = np.concatenate(own)[one], cid[one], np.concatenate(share)[one]
                cols = [np.concatenate([c, m]) for c, m in zip(cols, (more, np.full(len(more), -1), np.zeros(len(more))))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["f", "cid", "w"])
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(first.agg(F.sum(F.length("_t"))).first()[0] or 0) // 12_000_000)
    held = first.select("cid", every.alias("s")).mapInArrow(halves, "f long, cid long, w double").repartition(tasks, "f")
    single = held.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("cid").alias("cid"), F.max("w").alias("w")).where("n = 1 and cid >= 0")
    alone = single.groupBy("cid").agg(F.sum("w").alias("w")).where(F.col("w") > 1 - enough + 1e-9)
    left = first.join(stored(first.select("cid").join(alone, "cid", "left_anti"), "left"), "cid", "left_semi").select("cid", every.alias("s"))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(x.values.to_numpy()) for x in batch.column(1)]
            if own:
                f, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f[n > 2]), pa.array(n[n > 2])], names=["f", "n"])
    some = left.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, left.count() // sample))) == 0)
    often = some.mapInArrow(repeated, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "f").limit(frequent).select("f").toArrow().column("f").to_numpy()
    often = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, share = [], []
            for x in batch.column(1):
                f, n = np.unique(x.values.to_numpy(), return_counts=True)
                own.append(f)
                share.append(n ** 2.0 / (n ** 2.0).sum())
            if own:
                cid, f = np.repeat(batch.column(0).to_numpy(), list(map(len, own))), np.concatenate(own)
                salt = np.where(_among(f, often.value), 1 + cid % 1024, 0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cid, f, np.concatenate(share), salt)], names=["cid", "f", "w", "salt"])
    texts = F.when(F.col("salt") > 0, F.lit(1 << 62)).otherwise(F.count(F.lit(1)).over(Window.partitionBy("f", "salt")))
    shared = left.mapInArrow(entries, "cid long, f long, w double, salt long").select("cid", "f", "w", texts.alias("n")).where("n > 1")
    # from a shingle to the end of the order
    rest = F.sum("w").over(Window.partitionBy("cid").orderBy(F.desc("n"), "f").rowsBetween(Window.unboundedPreceding, 0))
    meets = shared.select("cid", "f", rest.alias("rest")).where(F.col("rest") >= enough - 1e-9)
    top = F.max(F.struct("rest", "cid")).over(Window.partitionBy("f"))
    stars = meets.select("cid", "rest", top.alias("top")).where((F.col("rest") * F.col("top.rest") >= enough - 1e-9) & (F.col("cid") != F.col("top.cid")))
    stars = stars.select(F.col("top.cid").alias("a"), F.col("cid").alias("b"))
    comps = connected_components(stars).select(F.col("v").alias("cid"), F.col("root").alias("comp"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([_pack(x.values.to_numpy()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["comp", "cid", "set"])
    wanted = first.join(comps, "cid").select("comp", "cid", every.alias("s"))
    members = stored(wanted.mapInArrow(packed, "comp long, cid long, set binary").withColumn("copies", F.lit(1).cast("long")), "members")
    links = verify(members, percent, block_members, block_grams, read=_unpack, similar=cosine_links)
    roots = connected_components(links.select(F.col("cid").alias("a"), F.col("to").alias("b"))).select(F.col("v").alias("cid"), F.col("root").alias("_root"))
    per_text = stored(first.select("_h", "_k", "cid").join(roots, "cid", "left").select("_h", "_k", F.coalesce("_root", "cid").alias("_root")), "grouped")
    least = stored(per_text.groupBy("_root").agg(F.min("_k").alias("group_id")), "least")
    groups = per_text.join(least, "_root").select("_h", "group_id")
    return same.select(key, "_h").join(groups, "_h").select(key, "group_id", (F.col("group_id") != F.col(key)).alias("near_copy"))
