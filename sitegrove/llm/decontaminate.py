"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item becomes windows of ``window`` consecutive words (one window
if it has fewer). A window occurs in a text only if all its shingles do, so one
shingle is enough as its prefix: the rarest one, by the number of documents that
hold it. The documents' shingles are joined with those prefixes only; a hit fixes
where the window would begin, and the position and length bounds throw out
beginnings before the text or ends after it. What is left is verified word by
word against the text.

All steps are DataFrame operations. Benchmark-sized tables are broadcast only if
they are counted to be at most ``broadcast_rows`` rows; otherwise the same joins
are left to the engine, which shuffles them. Nothing of one document is ever
multiplied by the number of documents that share a passage.

Defined results: null text has no words; items without words have no windows;
rows that repeat both id and text are one document and each comes back; items
that repeat an id add their windows to that id; a null item id takes no part; an
empty benchmark hits nothing; an empty table gives no rows; only id and text are
read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, pinned, query, table, write_out

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def _shingles(words: str, size: int) -> Column:
    """(pos, token): a hash of each run of ``size`` words, with its place."""
    n = F.size(words) - size + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(
        F.lit(size), *[F.get(F.col(words), i + j) for j in range(size)]).alias("token")))


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, len) of each different window and (wid, item_id)."""
    d = pinned(items.where(F.col("item_id").isNotNull()).select(F.col("item_id"), F.col("text")), words=words_of(F.col("text")))
    d = d.where(F.size("words") > 0).select("item_id", "words", F.explode(
        F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
    d = d.select("item_id", F.slice("words", F.col("at") + 1, window).alias("words"))
    d = d.withColumn("wid", F.sha2(F.array_join("words", " "), 256))  # words hold no blanks
    return (d.groupBy("wid").agg(F.first("words").alias("words")).withColumn("len", F.size("words")),
            d.select("wid", "item_id").distinct())


def _sized(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """A broadcast hint for a stored table counted to be small; else as it is."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                 broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, wid, at, len): each occurrence of a window in a document, and
    (wid, item_id)."""
    wins, members = item_windows(items, window)
    wins = write_out(wins, "windows")
    members = write_out(members, "window-items")
    sizes = [r["s"] for r in wins.select(F.least(F.col("len"), F.lit(shingle)).alias("s")).distinct().collect()]  # at most ``shingle`` values
    texts = docs.select("doc_id", "text").select(*doc_key(), "text")
    worded = pinned(texts, words=words_of(F.col("text"))).select("k1", "k2", "words")
    none = F.array().cast("array<struct<pos:int,token:bigint>>")
    doc_tokens = worded.select("k1", "k2", F.size("words").alias("n"), F.inline(F.concat(none, *[_shingles("words", s) for s in sizes])))
    win_tokens = write_out(wins.select("wid", "len", F.explode(F.concat(none, *[
        F.when(F.least(F.col("len"), F.lit(shingle)) == s, _shingles("words", s)).otherwise(none) for s in sizes])).alias("t"))
        .select("wid", "len", "t.pos", "t.token"), "window-shingles")

    # rarity: documents that hold each shingle of the benchmark
    vocabulary = write_out(win_tokens.select("token").distinct(), "shingle-set")
    held = doc_tokens.select("k1", "k2", "token").join(_sized(vocabulary, broadcast_rows), "token", "left_semi")
    rarity = held.groupBy("token").agg(F.count("*").alias("freq"))
    ranked = win_tokens.join(rarity, "token", "left")
    first = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "pos", "token", "len")).alias("p"))
    prefix = write_out(first.where(F.col("p.freq") > 0).select("wid", F.col("p.pos").alias("off"), F.col("p.token").alias("token"),
                                                               F.col("p.len").alias("len")), "window-prefixes")
    near = doc_tokens.join(_sized(prefix, broadcast_rows), "token").select(
        "k1", "k2", "wid", "len", (F.col("pos") - F.col("off")).alias("at"), "n")
    near = near.where((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("n")))
    per_doc = near.groupBy("k1", "k2").agg(F.collect_set(F.struct("wid", "at", "len")).alias("cands"))

    # exact verification against the words of the candidate documents
    cand = texts.join(per_doc, ["k1", "k2"])
    cand = pinned(cand, words=words_of(F.col("text")))
    cand = cand.select("k1", "k2", F.inline(F.transform("cands", lambda c: F.struct(
        c["wid"].alias("wid"), c["at"].alias("at"), c["len"].alias("len"),
        F.sha2(F.array_join(F.slice("words", c["at"] + 1, c["len"]), " "), 256).alias("found")))))
    hits = cand.where(F.col("found") == F.col("wid")).select("k1", "k2", "wid", "at", "len").distinct()
    return hits, members


def contamination(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with n_words, n_hit and
    item_ids (a sorted array of strings)."""
    hits, members = find_windows(docs, items, **params)
    hits = write_out(hits, "window-hits")
    # words covered: runs are sorted by place, so one pass adds what each adds
    runs = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("runs"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto"))
    covered = F.aggregate("runs", start, lambda a, r: F.struct(
        (a["sum"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["at"], a["upto"]))).alias("sum"),
        F.greatest(a["upto"], r["end"]).alias("upto")), lambda a: a["sum"])
    runs = runs.select("k1", "k2", covered.alias("n_hit"))
    found = hits.select("k1", "k2", "wid").distinct().join(members, "wid").groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(),
                       F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    per_doc = runs.join(found, ["k1", "k2"])
    out = rows.join(per_doc, ["k1", "k2"], "left")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, len, array_to_string(words[i:i + len - 1], ' ') AS win FROM (
    SELECT item_id, words, least(len(words), 10) AS len, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, i, len, array_to_string(words[i:i + len - 1], ' ') AS win FROM (
    SELECT doc_id, words, len, unnest(range(1, len(words) - len + 2)) AS i
    FROM d, (SELECT DISTINCT len FROM w) WHERE len(words) >= len)),
hits AS (SELECT dw.doc_id, dw.i, dw.len, w.item_id FROM dw JOIN w ON dw.len = w.len AND dw.win = w.win),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit h ON d.doc_id = h.doc_id LEFT JOIN items_hit t ON d.doc_id = t.doc_id
"""


@query("op9_prefix_join", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
