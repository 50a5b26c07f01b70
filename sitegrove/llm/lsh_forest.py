"""N-gram Jaccard join over a MinHash LSH forest.

Every text becomes the set of its word n-grams; texts with one set are one class
and go on as one row. A class has a signature of ``trees`` labels of ``depth``
hashes. In the sorted trie of a tree, two classes are candidates if they meet in a
node, that is if their labels share a prefix. Prefixes are shortened one hash at a
time, from the whole label, until a pair just at the threshold is found with at
least the target recall: 1 - (1 - threshold^length)^trees.

Nodes are turned into star edges and those into connected components, so that a
node with very many members costs one row each. Inside a component every pair is
verified on the n-gram sets themselves: small components share a task, a large one
is dealt into blocks of members and each pair of blocks is a task, which returns
counts and one edge for each member, never pairs. Verified links again give the
groups.

Defined results: a null text is an empty one; a text of fewer words than n is one
n-gram of all its words; a text without words has no links and is a group of its
own; rows that repeat are copies like any others and link to each other; ids may
be null (a group's class_id is its least id, null if it has none); an empty table
gives no rows; only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import _least_roots_across, links_between, verify  # noqa: F401
from .common import doc_key, query, table, write_out
from .components import components
from .textvec import ALNUM, RollingHash, chunks, mix, spans

_RNG = np.random.default_rng(77)
_PLACE = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of word n-gram hashes of each document; words are runs of
    letters and digits, A-Z folded."""
    doc, start, end = spans(ALNUM[data], offsets)
    rows = len(offsets) - 1
    if not len(doc):
        return [np.zeros(0, np.uint64)] * rows
    h = RollingHash(data).of(start, end)
    size = np.bincount(doc, minlength=rows)
    first = np.cumsum(size) - size
    g = np.zeros(len(h), np.uint64)
    for k in range(n):
        # past its end a document has empty words, which only short texts use
        at = np.arange(len(h)) + k
        inside = at < (first + size)[doc]
        g += np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0)) * _PLACE[k]
    g = mix(g)
    keep = np.maximum(size - n + 1, np.minimum(size, 1))
    return [np.unique(g[first[i]:first[i] + keep[i]]) for i in range(rows)]


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that identify the set."""
    with np.errstate(over="ignore"):
        a = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
        b = mix(grams * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Forest:
    """Labels of 16-bit hashes; trees and depth are parameters."""

    def __init__(self, trees: int = 24, depth: int = 8, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.mask = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)
        self.factor = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def label(self, grams: np.ndarray) -> bytes:
        x, low = (grams >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), 1024):
            part = ((x[i:i + 1024, None] ^ self.mask) * self.factor).min(0)
            low = part if low is None else np.minimum(low, part)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()

    def prefix_length(self, threshold: float, recall: float) -> int:
        """Shortened from the whole label until the recall is reached."""
        length = self.depth
        while length > 1 and 1 - (1 - threshold ** length) ** self.trees < recall:
            length -= 1
        return length


def signatures(docs: DataFrame, n: int, forest: Forest) -> DataFrame:
    """(rid, doc_id, k1, k2, s1, s2, grams, label) of every row; label is null for
    a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(3)):
                sets = ngrams(data, at, n)
                ids = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, len(sets)) for i in range(3)), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([forest.label(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "k1", "k2", "s1", "s2", "grams", "label"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text")
    rows = rows.mapInArrow(run, "doc_id long, k1 long, k2 long, s1 long, s2 long, grams long, label binary")
    return write_out(rows.withColumn("rid", F.monotonically_increasing_id()), "signatures")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, trees: int = 24, depth: int = 8,
                 block_members: int = 1024, block_grams: int = 2_000_000) -> DataFrame:
    """(rid, doc_id, k1, k2, group, class_id, n_links) of every row: ``group`` is
    one number for each group, class_id its least id, n_links the other rows whose
    similarity to this one is at least the threshold."""
    forest = Forest(trees, depth)
    rows = signatures(docs, n, forest)
    classes = rows.where("label is not null").groupBy("s1", "s2").agg(
        F.count("*").alias("copies"), F.min(F.struct("rid", "k1", "k2")).alias("rep"), F.min("label").alias("label"))
    classes = write_out(classes.select(F.col("rep.rid").alias("cid"), "s1", "s2", "rep.k1", "rep.k2", "copies", "label"), "classes")
    size = 2 * forest.prefix_length(threshold, recall)
    node = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.col("label").substr(t * (2 * depth) + 1, F.lit(size))))
    meets = classes.select("cid", F.explode(node).alias("node"))
    shared = meets.groupBy("node").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("node", "a")
    stars = meets.join(shared, "node").select("a", F.col("cid").alias("b"))
    comps = components(stars).select(F.col("v").alias("cid"), F.col("root").alias("comp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(3)):
                own = [s.astype("<u8").tobytes() for s in ngrams(data, at, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(own)) for i in range(3)), pa.array(own, pa.binary())],
                                                 names=["comp", "cid", "copies", "set"])
    wanted = classes.join(comps, "cid").select("k1", "k2", "comp", "cid", "copies")
    texts = docs.select(*doc_key(), "text").join(wanted, ["k1", "k2"]).select("comp", "cid", "copies", "text")
    members = texts.mapInArrow(run, "comp long, cid long, copies long, set binary").dropDuplicates(["cid"])
    found = write_out(verify(write_out(members, "members"), threshold, block_members, block_grams), "links")
    groups = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("v", "cid")
    linked = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    per_class = classes.select("cid", "s1", "s2", "copies").join(linked, "cid", "left").join(groups, "cid", "left").select(
        "s1", "s2", F.coalesce("root", "cid").alias("group"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    has = rows.where("label is not null").drop("grams", "label").join(per_class, ["s1", "s2"])
    has = write_out(has.select("rid", "doc_id", "k1", "k2", "group", "n_links"), "grouped")
    # stored, so that adaptive execution can split the rows of a large group
    least = write_out(has.groupBy("group").agg(F.min("doc_id").alias("class_id")), "least-ids")
    alone = rows.where("label is null").select("rid", "doc_id", "k1", "k2", F.col("rid").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return has.join(least, "group").select(*alone.columns).unionByName(alone)


def one_of_each_group(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, with the least id of each group (a null
    id after all others); of rows that repeat id and text, one."""
    joined = write_out(jaccard_join(docs, **params), "near-duplicates")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    stay = joined.groupBy("group").agg(F.min(key).alias("b")).select("b.k1", "b.k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key())
    return rows.join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


@query("op1_lsh_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
