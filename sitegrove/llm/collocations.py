"""Phrase collocations from an FM-index per shard.

1. Documents are read once, where they lie: each task splits its texts into
   words and deals them, by language, into shards of a bounded number of words
   (ids of the shard's own word list). Shards are stored; nothing of a text is
   shuffled.
2. Word lists with counts are summed over all shards. Words that reach the least
   count get a number; a phrase that reaches it holds no other words.
3. Each shard gets the numbers of its words and builds its FM-index. Every word
   is extended to the right and each pair to the left (see ``fm_index``): all
   phrases of two and three words with their counts. (numbers, count) rows are
   summed across shards; each shard gives a phrase once, so no key is hot.
4. Scores, containment and ranks are joins and a top-k window over the phrases
   that reach the least count.

A piece longer than a shard is cut with two words of overlap, and what lies
inside the overlap is counted off again, so counts are exact for any text.

Defined results: a null or empty text has no words; a null language is ``und``;
rows that repeat count as often as they occur; a language without a phrase gives
no row, an empty table none; only text and lang are read, so extra columns can
have any name. Scores are exact integers (decimals of 38 digits on the way).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import numbered
from .common import query, table, write_out
from .fm_index import FmIndex

END = b"\n"
# lower-cases A-Z, makes a tab a blank and every end of a piece a newline
_TO = bytes(ord(" ") if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))

SHARDS = "shard long, lang string, n long, words array<string>, counts array<long>, ids binary, size long"


class _Ids(dict):
    """Word -> id in order of appearance; 0 ends a piece, -1 is nothing."""

    def __init__(self):
        super().__init__({END: 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n

    def of(self, text: str) -> np.ndarray:
        """Ids of a text's words, a 0 after each piece."""
        parts = text.encode().translate(_TO).replace(END, b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        return np.append(ids[ids >= 0], np.int32(0))

    def words(self) -> list[str]:
        return [w.decode() for w in list(self)[2:]]


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a, "<i4").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), "<i4")


def _tidy(seq: np.ndarray) -> np.ndarray:
    """Without repeated ends; ends with one."""
    seq = np.append(seq, np.int32(0))
    return seq[(seq > 0) | np.concatenate([[False], seq[:-1] > 0])]


def make_shards(docs: DataFrame, shard_words: int = 2_000_000, overlap: int = 2) -> DataFrame:
    """Shards of the documents' words by language. ``size`` is negative for an
    overlap, whose counts are to be taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        held = dict.fromkeys(open_, 0)

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            words, parts = open_.pop(lang)
            del held[lang]
            seq, names = _tidy(np.concatenate(parts)), words.words()
            cuts = [0]
            while len(seq) - cuts[-1] > 2 * shard_words:  # a single text of more words than a shard
                cuts.append(cuts[-1] + shard_words)
            spans = [(max(0, a - overlap), b, 1) for a, b in zip(cuts, [*cuts[1:], len(seq)])] + [(max(0, a - overlap), a, -1) for a in cuts[1:]]
            for a, b, sign in spans:
                piece = _tidy(seq[a:b])
                count = np.bincount(piece, minlength=len(names) + 1)
                there = np.flatnonzero(count[1:]) + 1
                if not len(there):
                    continue
                local = np.zeros(len(names) + 1, np.int32)
                local[there] = np.arange(1, len(there) + 1)
                count = sign * count[there]
                row = {"shard": (part << 32) + made, "lang": lang, "n": int(count.sum()), "words": [names[i - 1] for i in there],
                       "counts": count, "ids": _pack(local[piece]), "size": sign * len(piece)}
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), (
                    pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.int64()))], names=list(row))

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in open_:
                    open_[lang], held[lang] = (_Ids(), []), 0
                ids = open_[lang][0].of(text.as_py())
                open_[lang][1].append(ids)
                held[lang] += len(ids)
                if sum(held.values()) > shard_words:
                    yield from rows(max(held, key=held.__getitem__))
        for lang in list(open_):
            yield from rows(lang)

    texts = docs.where("text <> ''").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, SHARDS)


def count_words(shards: DataFrame) -> DataFrame:
    """(lang, word, f) over all shards."""
    pairs = shards.select("lang", F.inline(F.arrays_zip("words", "counts")))
    return pairs.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where("f <> 0")


def count_phrases(shards: DataFrame, frequent: DataFrame, max_words: int = 3) -> DataFrame:
    """(tail, head, f): phrases of two to ``max_words`` (at most three) words of
    ``frequent`` (lang, word, id from 1). ``tail`` holds the ids of the last two
    words (first << 32 | second), ``head`` the id of the word before them or 0."""
    if max_words not in (2, 3):
        raise ValueError("max_words must be 2 or 3")
    pairs = shards.select("shard", "lang", F.posexplode("words").alias("at", "word"))
    known = pairs.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("id", "at")).alias("known"))
    index = shards.select("shard", "ids", "size").join(known, "shard").select("ids", "size", F.expr("transform(known, x -> x.id)").alias("id"),
                                                                              F.expr("transform(known, x -> x.at)").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, size, ids, at in zip(*(batch.column(c) for c in ("ids", "size", "id", "at"))):
                sign, n = (-1, -size.as_py()) if size.as_py() < 0 else (1, size.as_py())
                ids, at, seq = ids.values.to_numpy(), at.values.to_numpy(), _unpack(data.as_py(), n)
                order = np.argsort(ids)
                ids = np.append(np.int64(0), ids[order])
                local = np.zeros(int(seq.max()) + 1, np.int32)
                local[at[order] + 1] = np.arange(1, len(ids))
                index = FmIndex(_tidy(local[seq]), len(ids) - 1)
                pairs = index.extend_right(index.words())
                found = [(pairs, np.zeros(len(pairs.count), np.int64))]
                if max_words == 3:
                    triples = index.extend_left(pairs)
                    found.append((triples, ids[triples.words[:, 0]]))
                for x, head in found:
                    tail = (ids[x.words[:, -2]] << 32) | ids[x.words[:, -1]]
                    for lo in range(0, len(tail), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v[lo:lo + 100_000]) for v in (tail, head, sign * x.count)], names=["tail", "head", "c"])

    # a shard has summed its own phrases, so rows are dealt before any more sums
    counts = index.mapInArrow(run, "tail long, head long, c long").repartition("tail", "head")
    return counts.groupBy("tail", "head").agg(F.sum("c").alias("f"))


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000, max_words: int = 3, cover: int = 50,
                 shard_words: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each
    language that occur at least ``min_count`` times. A phrase inside a longer one
    with at least ``cover`` percent of its count is left out."""
    shards = write_out(make_shards(docs, shard_words), "shards")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = write_out(numbered(count_words(shards).where(F.col("f") >= min_count), ["lang", "word"], "id").withColumn("id", F.col("id") + 1), "words")
    found = write_out(count_phrases(shards, frequent, max_words).where(F.col("f") >= min_count), "phrases")

    first, second = F.shiftright("tail", 32), F.col("tail").bitwiseAND(0xFFFFFFFF)
    w = frequent.select("id", "lang", "word", "f")
    pairs = (found.where("head = 0").select("tail", F.col("f").alias("a"), first.alias("i"), second.alias("j"))
             .join(w.select(F.col("id").alias("i"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "i")
             .join(w.select(F.col("id").alias("j"), F.col("word").alias("w2"), F.col("f").alias("f2")), "j"))
    pairs = write_out(pairs.select("tail", "lang", "a", "w1", "f1", "w2", "f2"), "pairs")
    triples = found.where("head > 0").withColumn("start", F.shiftleft("head", 32).bitwiseOR(first))
    three = (triples.select("tail", "start", F.col("f").alias("a"))
             .join(pairs.select(F.col("tail").alias("start"), "lang", "w1", "f1", F.col("w2").alias("w"), F.col("a").alias("f12")), "start")
             .join(pairs.select("tail", F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23")), "tail"))

    def score(a: str, left: str, right: str) -> str:
        a, left, right = (f"cast({c} as decimal(15, 0))" for c in (a, left, right))
        return f"(1000000 * {a} * {a}) div ({left} * {right})"

    def cut(k: int, left: str, right: str):
        return F.struct(F.expr(score("a", left, right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    # the largest count of a longer phrase around each pair
    around = (triples.select(F.explode(F.array("start", "tail")).alias("tail"), "f").groupBy("tail").agg(F.max("f").alias("longer")))
    two = pairs.join(around, "tail", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    out = ["lang", "phrase", "a", "best"]
    rows = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(1, "f1", "f2").alias("best")).unionByName(
        three.select("lang", F.concat_ws(" ", "w1", "w", "w3").alias("phrase"), "a", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("best")))
    rows = rows.select(*out[:3], "best.score", "best.l", "best.r")
    from pyspark.sql import Window
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, t.cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM candidates c, (VALUES (1), (2)) AS t(cut), f x, f y
  WHERE t.cut < c.k AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(c.w[1:t.cut], ' ') AND y.phrase = array_to_string(c.w[t.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_pairs AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_pairs p ON b.k = 2 AND p.lang = b.lang AND p.phrase = b.phrase WHERE p.longer IS NULL OR 100 * p.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_fm_index", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
