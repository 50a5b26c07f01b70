"""Removal of byte strings that occur more than once, by suffix sorting.

Every string of ``length`` bytes has an anchor: the least hash among the ``gram``
byte grams in it (the first, if several are least). Equal strings have their
anchors at the same place, so strings are compared only where anchors have equal
grams; a document has one anchor for some fifty bytes.

1. An anchor's context is the union of the strings it stands for. Where a context
   occurs twice, all its strings are repeated; neighbours in the order of (gram,
   context) show that.
2. What is left are anchors whose gram repeats and whose context does not: the
   edges of repeated passages. They are compared with each other and with one
   anchor of each repeated context of the same gram. The strings of such an anchor are dealt into cells
   of ``cell`` consecutive starts. The bytes that all strings of a cell share are
   one symbol, so a cell is a short text: at most cell - 1 bytes, the symbol, at
   most cell - 1 bytes. Cells with an equal gram and equal shared bytes are joined
   to one text and suffix-sorted by linear grouping; a string is repeated if it
   equals its neighbour in the suffix order.
3. The runs of each document are united and cut out.

Hot keys: grams that a bounded sample of documents (``sample_docs``) shows to be
frequent are dealt by their contexts, and contexts that it shows twice are known to
repeat at once; the sample decides only where rows go. A cell text of more than
``sort_cells`` cells is not sorted: its strings are counted, one row each, which
gives the same answer. Grams, contexts and shared bytes are compared by 64-bit
hashes, always two of them together.

Defined results: a null text is empty; a text shorter than ``length`` stays whole;
rows that repeat id and text are documents like any others, so they repeat each
other; ids may be null; an empty table gives no rows; only id and text are read,
so other columns can have any name. Cutting bytes can split a character: results
are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_key, query, table, write_out
from .suffix_sort import suffix_array
from .textvec import CHUNK_BYTES, RollingHash, chunks, mix

ANCHOR = "key long, h long, c long, full boolean, one boolean, k1 long, k2 long, at long, lo int, hi int"


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, first byte, bytes, offsets); a text beyond the chunk size
    comes in pieces that overlap by length - 1 bytes."""
    if len(offsets) > 2 or len(data) <= 2 * CHUNK_BYTES:
        yield 0, 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, CHUNK_BYTES):
        part = data[at:at + CHUNK_BYTES + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """doc, at (within the document), lo and hi (how far before it its strings
    start, most and least), h (of its gram), c (of its context)."""
    none = np.zeros(0, np.int64)
    size, width = np.diff(offsets), length - gram + 1
    if len(data) < length or size.max() < length:
        return {"doc": none, "at": none, "lo": none, "hi": none, "h": none.view(np.uint64), "c": none.view(np.uint64)}
    rolling = RollingHash(data, folded=False)
    pos = np.arange(len(data) - gram + 1)
    h = rolling.of(pos, pos + gram)
    bits = np.uint64(int(len(data)).bit_length())
    least = ((h >> bits) << bits) | pos.astype(np.uint64)  # a tie goes to the first
    span = 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    start = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(offsets[:-1], offsets[1:]) if e - s >= length])
    at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    low, high = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    at, doc = at[new], doc[new]
    lo, hi = at - low, at - high
    c = mix(rolling.of(low, high + length) ^ (lo.astype(np.uint64) << np.uint64(32)) ^ hi.astype(np.uint64))
    return {"doc": doc, "at": at - offsets[doc], "lo": lo, "hi": hi, "h": h[at], "c": c}


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*doc_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@dataclass
class Hot:
    """What a sample shows to be frequent: grams; contexts (by a hash of gram and
    context, ascending) and an anchor of each."""
    grams: np.ndarray
    contexts: np.ndarray
    k1: np.ndarray
    at: np.ndarray

    def look_up(self, both: np.ndarray, k1: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context is hot, and this is the anchor that stands for it)."""
        if not len(self.contexts):
            return np.zeros(len(both), bool), np.zeros(len(both), bool)
        i = np.minimum(np.searchsorted(self.contexts, both), len(self.contexts) - 1)
        hot = self.contexts[i] == both
        return hot, hot & (self.k1[i] == k1) & (self.at[i] == at)


def find_anchors(keyed: DataFrame, length: int, gram: int, hot: Hot) -> DataFrame:
    """One row for each anchor. ``key`` says which rows must meet: those of a gram,
    or of a context where the gram is hot, or none where the context is; ``one``
    marks the anchor that stands for a hot context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(2)):
                for _, skipped, part, at in _pieces(data, offsets, length):
                    a = anchors(part, at, length, gram)
                    if not len(a["doc"]):
                        continue
                    both, where, place = mix(a["h"] * np.uint64(3) + a["c"]), a["doc"] + first, a["at"] + skipped
                    k1, k2 = (batch.column(i).to_numpy()[where] for i in (0, 1))
                    full, one = hot.look_up(both, k1, place)
                    spread = mix(both ^ k1.view(np.uint64) ^ place.astype(np.uint64))
                    key = np.where(full, spread, np.where(np.isin(a["h"], hot.grams), both, a["h"]))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a["h"].view(np.int64)), pa.array(a["c"].view(np.int64)), pa.array(full), pa.array(one),
                                                      pa.array(k1), pa.array(k2), pa.array(place), pa.array(a["lo"].astype(np.int32)), pa.array(a["hi"].astype(np.int32))],
                                                     names=["key", "h", "c", "full", "one", "k1", "k2", "at", "lo", "hi"])
    return keyed.mapInArrow(run, ANCHOR)


def _hot(keyed: DataFrame, length: int, gram: int, sample_docs: int, least: int = 8) -> Hot:
    """Grams and contexts that occur in ``least`` or more documents of a sample of
    about ``sample_docs``: at most that many anchors / least of each."""
    share = max(1, -(-keyed.count() // sample_docs))
    none = np.zeros(0, np.int64)
    sample = keyed.where(F.pmod(F.xxhash64(F.lit("hot"), "k1"), F.lit(share)) == 0)
    found = find_anchors(sample, length, gram, Hot(none.view(np.uint64), none.view(np.uint64), none, none))
    found = found.groupBy("h", "c", "k1").agg(F.min("at").alias("at")).groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "at")).alias("one"))
    found = write_out(found, "sampled-anchors")
    grams = found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    t = found.where(F.col("n") >= least).select("h", "c", "one.k1", "one.at").toArrow()
    h, c, k1, at = (t.column(x).to_numpy() for x in ("h", "c", "k1", "at"))
    both = mix(h.view(np.uint64) * np.uint64(3) + c.view(np.uint64))
    order = np.argsort(both)
    return Hot(grams, both[order], k1[order], at[order])


def repeated_anchors(found: DataFrame) -> DataFrame:
    """The anchors whose gram repeats. ``full``: the context repeats. ``cut``: its
    strings are compared one by one; of a repeated context one anchor is, where
    other contexts have its gram."""
    order = Window.partitionBy("key").orderBy("h", "c")
    every = Window.partitionBy("key", "h")
    for name in ("h", "c"):
        for side in (F.lag, F.lead):
            found = found.withColumn(f"{name}_{side.__name__}", side(name).over(order))
    found = found.withColumn("others", F.min("c").over(every) != F.max("c").over(every))
    no = F.lit(False)
    before_h, after_h = (F.coalesce(F.col("h") == F.col(f"h_{s}"), no) for s in ("lag", "lead"))
    before, after = (x & F.coalesce(F.col("c") == F.col(f"c_{s}"), no) for x, s in ((before_h, "lag"), (after_h, "lead")))
    hot = F.col("key") != F.col("h")  # dealt by context: the gram is known to repeat
    full = F.col("full") | before | after
    stands = F.when(F.col("full"), F.col("one")).otherwise(~before) & (hot | F.col("others"))
    found = found.withColumns({"repeats": full, "cut": ~full | stands, "twice": full | hot | before_h | after_h})
    return found.where("twice").select("k1", "k2", "at", "lo", "hi", "h", F.col("repeats").alias("full"), "cut")


def union_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.concatenate([new[1:], [len(start)]]) - 1]


CELL = "struct<h:bigint,core:bigint,g:int,at:bigint,lo:int,hi:int,left:binary,right:binary>"


def document_cells(docs: DataFrame, found: DataFrame, length: int, cell: int) -> DataFrame:
    """Per document with repeated anchors: the runs known to repeat, and the cells
    of the anchors to compare, with the bytes around what a cell's strings share."""
    per_doc = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "lo", "hi", "h", "full", "cut")).alias("a"))
    rows = docs.join(per_doc, ["k1", "k2"])
    run_type, cell_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct(
        [("h", pa.int64()), ("core", pa.int64()), ("g", pa.int32()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))

    def one(text: bytes, a: dict) -> tuple[list, list]:
        at, lo, hi, h, full, cut = a
        start, end = (at - lo)[full], (at - hi + length)[full]
        runs = list(zip(*(x.tolist() for x in union_runs(start, end)))) if len(start) else []
        cells = []
        if cut.any():
            rolling = RollingHash(np.frombuffer(text, np.uint8), folded=False)
            for p, most, least, gram in zip(*(x[cut].tolist() for x in (at, lo, hi, h))):
                for g in range(least // cell, most // cell + 1):
                    near, far = g * cell, g * cell + cell - 1  # starts p - far .. p - near
                    a0, a1 = p - near, p - far + length  # what they all share
                    cells.append((gram, a0, a1, g, p, min(far, most), max(near, least)))
            core = rolling.of(np.array([x[1] for x in cells]), np.array([x[2] for x in cells])).view(np.int64).tolist()
            cells = [{"h": gram, "core": k, "g": g, "at": p, "lo": most, "hi": least, "left": text[p - most:a0], "right": text[a1:p - least + length]}
                     for (gram, a0, a1, g, p, most, least), k in zip(cells, core)]
        return [{"start": s, "end": e} for s, e in runs], cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, cut = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(6)]
            out = [one(t.as_py().encode(), tuple(x[i:j] for x in fields)) for t, i, j in zip(batch.column(2), cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r for r, _ in out], run_type), pa.array([c for _, c in out], cell_type)],
                                             names=["k1", "k2", "runs", "cells"])
    schema = f"k1 long, k2 long, runs array<struct<start:bigint,end:bigint>>, cells array<{CELL}>"
    return rows.select("k1", "k2", "text", "a").mapInArrow(run, schema)


def sort_cells(rows: list[tuple[bytes, bytes, int, int, int]], cell: int) -> list[tuple[int, int, int]]:
    """rows: (left, right, least start, most start, class) of cells, counted back
    from their shared bytes. (row, first, last): the strings that repeat within a
    class, by their start. One suffix array over all cells."""
    text, place, classes = [], [], {}
    for left, right, *_, name in rows:
        place.append(len(text) + len(left))
        text += [b + 1 for b in left]
        text.append(257 + classes.setdefault(name, len(classes)))
        text += [b + 1 for b in right]
        text.append(0)
    owner = {}
    for r, (_, _, least, most, _) in enumerate(rows):
        for o in range(least, most + 1):
            owner[place[r] - o] = (r, o)
    # strings in suffix order; all have ``cell`` symbols, one of them shared
    order = [s for s in suffix_array(text) if s in owner]
    found: dict[int, list[int]] = {}
    for s, t in zip(order, order[1:]):
        if text[s:s + cell] == text[t:t + cell]:
            for x in (s, t):
                r, o = owner[x]
                found.setdefault(r, []).append(o)
    return [(r, min(o), max(o)) for r, o in found.items()]


def repeated_cells(stored: DataFrame, cell: int, length: int, sort_limit: int, task_cells: int) -> DataFrame:
    """(k1, k2, start, end) of the runs that the cells' strings repeat."""
    cells = stored.select("k1", "k2", F.inline("cells"))
    names = ["h", "core", "g"]
    sizes = cells.groupBy(*names).agg(F.count("*").alias("n")).where("n >= 2")
    met = write_out(cells.join(sizes, names), "cells")
    tasks = max(1, -(-met.count() // task_cells))

    def run(t: pa.Table) -> pa.Table:
        col = {n: t.column(n).to_pylist() for n in ("left", "right", "lo", "hi", "g", "h", "core")}
        rows = [(l, r, hi - g * cell, lo - g * cell, (h, k, g)) for l, r, lo, hi, g, h, k in zip(*(col[x] for x in ("left", "right", "lo", "hi", "g", "h", "core")))]
        out = sort_cells(rows, cell)
        at, g = t.column("at").to_numpy(), np.array(col["g"], np.int64)
        r, first, last = (np.array(x, np.int64) for x in (zip(*out) if out else ((), (), ())))
        start, end = (at - g * cell)[r] - last if len(r) else r, (at - g * cell)[r] - first + length if len(r) else r
        keep = t.select(["k1", "k2"]).take(pa.array(r))
        return keep.append_column("start", pa.array(start)).append_column("end", pa.array(end))

    schema = "k1 long, k2 long, start long, end long"
    few = met.where(F.col("n") <= sort_limit)
    sorted_ = few.groupBy(F.pmod(F.xxhash64(*names), F.lit(tasks)).alias("task")).applyInArrow(run, schema)
    # very large classes: one row for each string, counted
    many = met.where(F.col("n") > sort_limit).select("k1", "k2", "at", "lo", *names, "left", "right", F.explode(F.sequence("hi", "lo")).alias("o"))
    o, near, far = F.col("o"), F.col("g") * cell, F.col("g") * cell + cell - 1
    many = many.select("k1", "k2", *names, "o", (F.col("at") - o).alias("start"),
                       F.concat(F.substring("left", F.length("left") - (o - near) + 1, o - near), F.lit(b""), F.substring("right", F.lit(1), far - o)).alias("around"))
    twice = many.groupBy(*names, "o", "around").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    counted = many.join(twice, [*names, "o", "around"]).select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    return sorted_.unionByName(counted)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, cell: int = 16, sample_docs: int = 2048, sort_limit: int = 4096,
                   task_cells: int = 5_000) -> DataFrame:
    """(doc_id, n_bytes, kept, runs) of every row: the remaining bytes, and the
    maximal removed runs (start, end)."""
    keyed = _keyed(docs)
    hot = _hot(keyed, length, gram, sample_docs)
    found = repeated_anchors(find_anchors(keyed, length, gram, hot))
    stored = write_out(document_cells(keyed, found, length, cell), "repeats")
    runs = stored.select("k1", "k2", F.inline("runs")).unionByName(repeated_cells(stored, cell, length, sort_limit, task_cells))
    per_doc = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(per_doc, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, kept, cut = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                body = text.as_py().encode()
                start, end = union_runs(*(np.array([r[x] for r in found], np.int64) for x in ("start", "end"))) if found else ((), ())
                n_bytes.append(len(body))
                kept.append(b"".join(body[a:b] for a, b in zip([0, *end], [*start, len(body)])))
                cut.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()),
                                              pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "runs"])
    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, runs array<struct<start:bigint,end:bigint>>")


@query("op3_lyndon_groups")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
