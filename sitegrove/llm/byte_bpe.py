"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is split by the tokenizer's pattern. Tier one is a minimal perfect hash
over the vocabulary (buckets of keys with a displacement each, found largest
bucket first): it maps the distinct pre-tokens of a chunk to slots in numpy, and
one comparison of the bytes in the slot tells a whole pre-token of the
vocabulary from any other. Tier two merges the rest: bytes as a linked list, a
heap of (rank, place) over the joins, out-of-date entries skipped, so a
pre-token of n bytes costs n log n however long it is. Results are remembered
by each worker up to a fixed number of pre-tokens.

The tables are built on the driver from the rank file and broadcast; their size
is that of the vocabulary. Documents are mapped in Arrow batches, no shuffle.

Defined results: a null text is an empty one (no ids, no bytes); each row is
encoded by itself, so repeated rows and ids stay as they are; an empty table
gives no rows; only the id and text columns are read, so extra columns can have
any name; a text of any length is encoded whole. Null ids in an array and a null
array decode to nothing.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, table
from .textvec import CHUNK_BYTES, RollingHash, mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank; ranks must be 0, 1, 2, ... without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks are not 0 .. n-1")
    return [tokens[i] for i in range(len(tokens))]


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each key, from one rolling hash over all of them."""
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(keys) else ends
    return RollingHash(np.frombuffer(b"".join(keys), np.uint8), folded=False).of(starts, ends) + (ends - starts).astype(np.uint64)


class PerfectHash:
    """Minimal perfect hash: n keys onto the slots 0 .. n-1."""

    def __init__(self, hashes: np.ndarray, per_bucket: int = 4):
        n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys are not distinct")
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            keys, base, found = hashes[order[starts[b]:starts[b + 1]]], 0, None
            while found is None:
                tries = np.arange(base, base + 64)
                slots = np.sort(self._slot(keys[None, :], tries[:, None]), axis=1)
                good = ~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if good.any():
                    found = int(np.argmax(good))
                base += 64
            self.shift[b] = tries[found]
            taken[slots[found]] = True
        # a bucket of one key names a free slot outright
        ones = np.flatnonzero(sizes == 1)
        self.shift[ones] = -1 - np.flatnonzero(~taken)[:len(ones)]

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + (shift.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot for what is no key."""
        shift = self.shift[self._bucket(hashes)]
        return np.where(shift < 0, -1 - shift, self._slot(hashes, np.maximum(shift, 0)))


class Merges:
    """Ids of a pre-token by its merges: least rank first, then leftmost."""

    def __init__(self, tokens: list[bytes]):
        ranks = {t: i for i, t in enumerate(tokens)}
        self.lengths = list(map(len, tokens))
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        # (left part's id << 32 | right part's id) -> id of the whole, for every two parts of a token
        self.whole = {x << 32 | y: i for t, i in ranks.items() for k in range(1, len(t))
                      if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None}

    def __call__(self, piece: bytes) -> list[int]:
        n, get, lengths, pop, push = len(piece), self.whole.get, self.lengths, heapq.heappop, heapq.heappush
        ids = [self.of_byte[b] for b in piece]  # of the part that starts at i
        end = list(range(1, n + 1))             # of that part; 0: no part starts there
        before = list(range(-1, n))
        # a join is rank * n + place; its end follows from the rank's length
        heap = [r * n + i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            r = x // n
            i = x - r * n
            middle, stop = end[i], i + lengths[r]
            if not middle or middle >= n or end[middle] != stop:
                continue
            ids[i], end[i], end[middle] = r, stop, 0
            if stop < n:
                before[stop] = i
                if (q := get(r << 32 | ids[stop])) is not None:
                    push(heap, q * n + i)
            if (p := before[i]) >= 0 and (q := get(ids[p] << 32 | r)) is not None:
                push(heap, q * n + p)
        return [x for x, e in zip(ids, end) if e]


def _splitters(pattern: str) -> tuple[regex.Pattern, regex.Pattern, int]:
    """The pattern for texts whose bytes all lie below the returned one, and the
    pattern for any text. The tokenizer library knows fewer letters and numbers
    than a newer Unicode table; it is asked for its own classes, and the
    characters on which the two differ are excepted."""
    import tiktoken
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    plain = {bytes([i]): i for i in range(256)}
    exact, odd = pattern, []
    for name in (r"\p{L}", r"\p{N}"):
        theirs = set(bytes(tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=plain, special_tokens={}).encode_ordinary(every)).decode())
        differ = sorted(set(regex.findall(name, every)) - theirs)
        if differ:
            odd.append(differ[0])
            # inside a negated class the excepted characters count as others
            exact = exact.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "(?:(?!\\p{L}|\\p{N})\\S)").replace(name, f"[{name}--[{''.join(differ)}]]")
    limit = min((c.encode()[0] for c in odd), default=256)
    return regex.compile(pattern), regex.compile(exact, regex.V1), limit


class ByteBpe(dict):
    """Pre-token -> little-endian ids, filled on demand; cleared at ``limit``."""

    def __init__(self, tokens: list[bytes], index: PerfectHash, slots: np.ndarray, pattern: str, limit: int = 800_000):
        super().__init__()
        self.tokens, self.index, self.slots, self.limit = tokens, index, slots, limit
        self.merge = Merges(tokens)
        self.split, self.split_any, self.odd_byte = _splitters(pattern)

    def pre_tokens(self, text: str) -> list[str]:
        plain = text.isascii() or int(np.frombuffer(text.encode(), np.uint8).max()) < self.odd_byte
        return (self.split if plain else self.split_any).findall(text)

    def learn(self, fresh: list[str]) -> None:
        keys = [p.encode() for p in fresh]
        for p, key, rank in zip(fresh, keys, self.slots[self.index(hash_keys(keys))].tolist()):
            ids = (rank,) if self.tokens[rank] == key else self.merge(key)
            self[p] = pack(f"<{len(ids)}i", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The distinct pre-tokens of all texts are looked up
        once, the first tier runs over all new ones together."""
        if len(self) > self.limit:
            self.clear()
        parts = [self.pre_tokens(t) for t in texts]
        every = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        distinct, which = every.dictionary.to_pylist(), every.indices.to_numpy()
        if fresh := [p for p in distinct if p not in self]:
            self.learn(fresh)
        held = [self[p] for p in distinct]
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first, ids = np.cumsum(size) - size, np.frombuffer(b"".join(held), "<i4")
        count = size[which]
        end = np.cumsum(count)
        ids = ids[np.repeat(first[which] - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)]
        return np.split(ids, np.concatenate([[0], end])[np.cumsum(list(map(len, parts)))[:-1]])


def build(tokens: list[bytes]) -> tuple[list[bytes], PerfectHash, np.ndarray]:
    hashes = hash_keys(tokens)
    index = PerfectHash(hashes)
    slots = np.zeros(len(tokens), np.int32)
    slots[index(hashes)] = np.arange(len(tokens), dtype=np.int32)
    return tokens, index, slots


_WORKER: dict[tuple, ByteBpe] = {}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows of a bounded amount of text; a longer text is a chunk of its own."""
    for batch in batches:
        ids, texts, lo, size = batch.column(0), batch.column(1), 0, 0
        held: list[str] = []
        for i, value in enumerate(texts):
            t = value.as_py() or ""
            if held and size + len(t) > CHUNK_BYTES:
                yield ids.slice(lo, i - lo), held
                lo, size, held = i, 0, []
            held.append(t)
            size += len(t)
        if held:
            yield ids.slice(lo, len(held)), held


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))


def _bytes_of(tokens: list[bytes], ids: list[int | None]) -> bytes:
    return b"".join([tokens[i] for i in ids if i is not None])


def _mapped(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, decoded: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(build(read_ranks(path)))
    key = (path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER[key] = ByteBpe(*shared.value, pattern)
        bpe = _WORKER[key]
        for doc_ids, held in _chunks(batches):
            found = bpe.encode(held)
            cols = {"doc_id": doc_ids, "ids": _lists(found)}
            if decoded:
                cols["decoded"] = pa.array([_bytes_of(bpe.tokens, x.tolist()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.BinaryType())] if decoded else []
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _mapped(docs, path, pattern, doc_id, text, decoded=False)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): each text encoded and its ids decoded again, in one pass."""
    return _mapped(docs, path, pattern, doc_id, text, decoded=True)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * CHUNK_BYTES // max(1, batch.nbytes))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                texts = [_bytes_of(shared.value, x.as_py() or []) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


@query("op12_two_tier_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    d = round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
