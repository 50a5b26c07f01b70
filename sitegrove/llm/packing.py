"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised once (Arrow batches, per-worker word cache) into pieces
of at most ``capacity`` ids; only (id, piece, length, checksum) rows go on. The
pieces are dealt into shards of a bounded number of rows and each shard is
packed on its own: a bin is filled greedily with the longest piece that still
fits, then its smallest piece is exchanged for the two unpacked pieces that fill
the widened gap most tightly, if they fill it better. A shard leaves at most its
last bins part-filled, so sharding costs a small constant per ``shard_rows``.

Defined results: a null text is an empty one (a single end id); every row is
packed, repeated rows as often as they occur; an empty table gives no rows; only
the id and text columns are read, so extra columns can have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table, write_out

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
# letters that are single code points in NFC with one-to-one lower case, then
# marks that are neither letters, digits, blanks nor an apostrophe
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:$&*%#|]*)")


class _WordIds(dict):
    """Bytes of the little-endian ids of a blank-free chunk of text. The
    tokenizer never joins across a blank or newline and lower-cases, and a run of
    letters is one unit of its own, so chunks can be encoded one by one and plain
    words go straight to the tokenizer's model. Cleared at ``limit`` entries."""

    def __init__(self, tokenizer, limit: int):
        super().__init__({"": b""})
        from tokenizers import pre_tokenizers
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tok, self.model, self.limit, self.words = tokenizer, tokenizer.model, limit, {}
        self.as_bytes = {c: bytes_of(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _encode(self, s: str) -> bytes:
        return np.asarray(self.tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
            self.words.clear()
        m = _PLAIN.fullmatch(chunk)
        if m:
            word, mark = m[1].lower(), m[2]
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = np.asarray([t.id for t in self.model.tokenize(word.translate(self.as_bytes))], dtype="<u4").tobytes()
            if mark:
                ids = ids + (self.words.get(mark) or self.words.setdefault(mark, self._encode(mark)))
        else:
            ids = self._encode(chunk)
        self[chunk] = ids
        return ids


_CACHES: dict[str, _WordIds] = {}


def word_ids(path: str, limit: int = 600_000) -> _WordIds:
    """The worker's cache for the tokenizer file; it lives as long as the worker."""
    if path not in _CACHES:
        from tokenizers import Tokenizer
        _CACHES[path] = _WordIds(Tokenizer.from_file(path), limit)
    return _CACHES[path]


def encode(cache: _WordIds, text: str) -> bytes:
    return b"".join(map(cache.__getitem__, text.replace("\n", " ").split(" ")))


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one
    ``end_id``, cut into pieces of ``capacity`` where it is longer."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(cache, text.as_py() or "") + end
                for i in range(0, len(ids), width):
                    part = ids[i:i + width]
                    out.append((doc_id, i // width, i // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                a = list(zip(*out))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, types)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECE_SCHEMA)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece. Works on counts per length, so a step costs
    the same for any number of pieces."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    nxt = np.concatenate([[0], np.cumsum(counts)])[:-1].copy()  # next unplaced piece of a length
    grid = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(counts > 0, grid, 0))  # longest present length up to x
    left = len(lengths)

    def change(length: int, by: int) -> None:
        counts[length] += by
        if counts[length] == (0 if by < 0 else 1):
            end = length + 1 + int(np.argmax(counts[length + 1:] > 0)) if (counts[length + 1:] > 0).any() else capacity + 1
            below[length:end] = length if by > 0 else below[length - 1]

    bins = []
    while left:
        gap, held = capacity, []
        while gap and (x := int(below[gap])):
            held.append(x)
            change(x, -1)
            gap -= x
        if gap and left > len(held):
            smallest, room = held[-1], gap + held[-1]
            a = np.flatnonzero(counts[:room])
            if len(a):
                b = below[room - a]
                b = np.where((b == a) & (counts[a] < 2), below[np.maximum(a - 1, 0)], b)
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    held[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
                    change(smallest, 1)
                    change(held[-1], -1)
                    change(held[-2], -1)
        left -= len(held)
        bins.append(held)
    bin_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, held in enumerate(bins):
        at = 0
        for x in held:
            row = order[nxt[x]]
            nxt[x] += 1
            bin_of[row], offset_of[row] = i, at
            at += x
    return bin_of, offset_of


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 16384) -> DataFrame:
    """``pieces`` (any columns, with ``length`` between 1 and ``capacity``) and
    their sequence_id and offset. The pieces are written once to the shared
    folder, then dealt by their stored row number."""
    given = pieces.columns
    rows = write_out(pieces.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"),
                                   F.col("length").cast("long").alias("len"),
                                   F.monotonically_increasing_id().alias("rid")), "pieces")
    shards = max(1, -(-rows.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        bin_of, offset_of = best_two_fit(t.column("len").to_numpy(), capacity)
        return pa.table({"row": t.column("row"), "sequence_id": (t.column("shard")[0].as_py() << 32) + bin_of, "offset": offset_of})

    row_type = rows.schema["row"].dataType.simpleString()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(run, f"row {row_type}, sequence_id long, offset long")
    return packed.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   shard_rows: int = 16384) -> DataFrame:
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id), capacity, shard_rows)


@query("op7_best_two_fit")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
