"""Near-match at scale (G12): MinHash signatures over word shingles with
locality-sensitive banding: shingles by Spark SQL functions, signatures and
verification of their 64-bit hashes in Arrow batches.

Bands only make candidates: the star edges from a band's first member to the
others give candidate components. Inside a component every pair is verified on
the hashed shingle sets, in blocks (``pairs.verify``), whether or not either is
similar to a band's first member; groups are the connected components of the
pairs that reach the threshold. The time grows with the square of a component.
Texts with equal normalised text are one row of this, whatever their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint_normalize
from ..session import ensure_checkpoint_dir
from .graph import connected_components
from .pairs import verify


def hashes(text: Column, k: int = 5) -> Column:
    """The distinct 64-bit hashes of the word k-grams of the normalised text (of the
    whole text when it has fewer than k words): repeats are found among numbers,
    not among strings. The word array is bound once (one-element ``transform``) so
    the lambda does not re-split the text per k-gram."""
    words = F.split(fingerprint_normalize(text), " ", -1)
    return F.element_at(F.transform(F.array(words), lambda w: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))))), 1)


def near_match_groups(docs: DataFrame, key: str, text: str, bands: int = 16, rows: int = 4,
                      threshold: float = 0.8, block_members: int = 1024, block_grams: int = 2_000_000,
                      chunk: int = 1 << 16) -> DataFrame:
    """(key, group_id, near_copy): group_id is the smallest key of the group of
    documents connected by verified similarity (itself when there is none)."""
    rng = np.random.default_rng(12)
    seed, factor, place = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            x, at = lists.values.to_numpy().view(np.uint64)[at[0]:at[-1]], at - at[0]
            keys = np.zeros((bands, len(lists)), np.uint64)  # every text has a shingle
            cut = [0, *(np.flatnonzero(np.diff(at[:-1] // chunk)) + 1), len(lists)]  # some texts at a time, which stay in the cache
            for lo, hi in zip(cut, cut[1:]):
                part, starts = x[at[lo]:at[hi]], at[lo:hi] - at[lo]
                for i in range(bands * rows if hi > lo else 0):
                    h = part ^ seed[i]
                    h *= factor[i]
                    h ^= h >> np.uint64(32)
                    keys[i // rows, lo:hi] += np.minimum.reduceat(h, starts) * place[i]
            cid = np.tile(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(keys.view(np.int64).ravel())], names=["cid", "band"])

    # the hash is made once, in a generator: no filter on it normalises again
    digest = F.sha2(fingerprint_normalize(F.col("_t")), 256)
    same = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).select("*", F.inline(F.array(F.struct(digest.alias("_h")))))
    first = same.groupBy("_h").agg(F.min(F.struct(key, "_t")).alias("_m"))
    first = first.select("_h", F.col(f"_m.{key}").alias("_k"), "_m._t", F.monotonically_increasing_id().alias("cid"))
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/near-match-{uuid.uuid4().hex}"
    first.write.parquet(path)
    first = docs.sparkSession.read.schema(first.schema).parquet(path)
    hashed = hashes(F.col("_t"))
    per_band = first.select("cid", hashed.alias("_sh")).mapInArrow(run, "cid long, band long").checkpoint()
    reps = per_band.groupBy("band").agg(F.min("cid").alias("rep"), F.max("cid").alias("_z")).filter("rep < _z").select("band", "rep")
    stars = per_band.join(reps, "band").select(F.col("rep").alias("a"), F.col("cid").alias("b"))
    comps = connected_components(stars).select(F.col("v").alias("cid"), F.col("root").alias("comp"))
    # the set as 8 bytes a shingle, for candidates only
    packed = F.unhex(F.array_join(F.transform(hashed, lambda h: F.lpad(F.hex(h), 16, "0")), ""))
    members = first.select("cid", "_t").join(comps, "cid").select("comp", "cid", F.lit(1).cast("long").alias("copies"), packed.alias("set")).checkpoint()
    edges = verify(members, threshold, block_members, block_grams).select(F.col("cid").alias("a"), F.col("to").alias("b"))
    roots = connected_components(edges).select(F.col("v").alias("cid"), F.col("root").alias("_root"))
    per_text = first.select("_h", "_k", "cid").join(roots, "cid", "left").select("_h", "_k", F.coalesce("_root", "cid").alias("_root")).checkpoint()
    # stored, so that adaptive execution can split the rows of a large group
    least = per_text.groupBy("_root").agg(F.min("_k").alias("group_id")).checkpoint()
    groups = per_text.join(least, "_root").select("_h", "group_id")
    return same.select(key, "_h").join(groups, "_h").select(key, "group_id", (F.col("group_id") != F.col(key)).alias("near_copy"))
