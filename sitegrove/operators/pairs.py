"""Verification of all pairs inside candidate components, on the sets themselves:
small components share a task, a large one is dealt into blocks of members and
each pair of blocks is a task, which returns counts and one edge for each member,
never pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links_between(a: list[np.ndarray], b: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Whether each set of a and each of b reach the threshold. Only n-grams found
    on both sides count; they are handled in column blocks of a 0/1 matrix."""
    size_a, size_b = (np.array([len(s) for s in x]) for x in (a, b))
    own_a, own_b = (np.repeat(np.arange(len(s)), s) for s in (size_a, size_b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    both = np.zeros((len(a), len(b)), np.float32)
    at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
    in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
    own_a, at_a, own_b, at_b = own_a[in_a], at_a[in_a], own_b[in_b], at_b[in_b]
    oa, ob = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    own_a, at_a, own_b, at_b = own_a[oa], at_a[oa], own_b[ob], at_b[ob]
    for c in range(0, len(shared), columns):
        width = min(columns, len(shared) - c)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        i, j = np.searchsorted(at_a, [c, c + width]), np.searchsorted(at_b, [c, c + width])
        x[own_a[i[0]:i[1]], at_a[i[0]:i[1]] - c] = 1
        y[own_b[j[0]:j[1]], at_b[j[0]:j[1]] - c] = 1
        both += x @ y.T
    both = both.astype(float)
    return both / (size_a[:, None] + size_b - both) >= threshold


def _least_roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least id of each row's component, for a square matrix of links."""
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(linked, root, root.max()).min(1))
        if (new == root).all():
            return root
        root = new


def _least_roots_across(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each row's and of each column's component, for a matrix of
    links between the ids a and the ids b. Each row and column is visited once."""
    root_a, root_b = a.copy(), b.copy()
    new_a, new_b = np.ones(len(a), bool), np.ones(len(b), bool)
    for first in range(len(a)):
        if not new_a[first]:
            continue
        rows, all_rows, all_cols = np.array([first]), [], []
        while len(rows):
            new_a[rows] = False
            all_rows.append(rows)
            cols = np.flatnonzero(linked[rows].any(0) & new_b)
            new_b[cols] = False
            all_cols.append(cols)
            rows = np.flatnonzero(linked[:, cols].any(1) & new_a)
        in_a, in_b = np.concatenate(all_rows), np.concatenate(all_cols)
        root_a[in_a] = root_b[in_b] = min(a[in_a].min(), b[in_b].min(initial=np.iinfo(np.int64).max))
    return root_a, root_b


def verify(members: DataFrame, threshold: float, block_members: int, block_grams: int, read=lambda x: np.frombuffer(x, "<u8"),
           similar=links_between) -> DataFrame:
    """members: (comp, cid, copies, set). (cid, linked, to): documents linked to
    the class in some task, and the least class it is connected with there.
    ``read`` makes the bytes of ``set`` an array, ``similar`` compares two lists of
    arrays."""
    totals = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.length("set") / 8).alias("g"))
    blocks = F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("g") / block_grams)).cast("long")
    d = members.join(totals.select("comp", blocks.alias("nb")), "comp")
    # small components by a hash of their id, large ones by pairs of blocks; a
    # group of small ones holds about a block, however many there are
    all_small = totals.where((F.col("m") <= block_members) & (F.col("g") <= block_grams)).agg(F.sum("m").alias("m"), F.sum("g").alias("g")).first()
    groups = max(4096, -(-int(all_small["m"] or 0) // block_members), -(-int(all_small["g"] or 0) // block_grams))
    small = d.where("nb = 1").select(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("g"),
                                     "comp", "cid", "copies", "set", F.lit(0).cast("long").alias("mine"))
    mine = F.pmod(F.xxhash64("cid"), F.col("nb"))
    large = d.where("nb > 1").select("comp", "cid", "copies", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    large = large.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("comp").alias("g"), "comp", "cid", "copies", "set", "mine")

    def run(t: pa.Table) -> pa.Table:
        comp, cid, copies, mine = (t.column(c).to_numpy() for c in ("comp", "cid", "copies", "mine"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sets = [read(x.as_py()) for x in t.column("set")]
        out_id, out_linked, out_to = [], [], []
        if i == j:  # whole components, or a block with itself
            order = np.argsort(comp, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
                own = [sets[r] for r in rows]
                linked = similar(own, own, threshold)
                np.fill_diagonal(linked, False)
                out_id.append(cid[rows])
                out_linked.append(linked @ copies[rows])
                out_to.append(_least_roots(cid[rows], linked))
        else:
            a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if len(a) and len(b):
                linked = similar([sets[r] for r in a], [sets[r] for r in b], threshold)
                for x, m, root in zip((a, b), (linked, linked.T), _least_roots_across(cid[a], cid[b], linked)):
                    out_id.append(cid[x])
                    out_linked.append(m @ copies[b if x is a else a])
                    out_to.append(root)
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_id, out_linked, out_to)]
        return pa.table([pa.array(x.astype(np.int64)) for x in cat], names=["cid", "linked", "to"])

    return small.unionByName(large).groupBy("g", "i", "j").applyInArrow(run, "cid long, linked long, to long")
