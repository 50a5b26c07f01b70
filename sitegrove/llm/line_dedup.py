"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches, largest ids first, so the first run that holds a line
also knows the largest document that holds it. A run is a sorted table of
(line hash, number of documents, largest document). Each batch counts its own
lines, merge-anti-joins the lines that the runs have already settled (seen in
enough documents: they need no more counting) and adds the rest as a new run of
level 0. When a level has ``fan_out`` runs they are merged into one run of the
next level, which settles lines whose documents lie in different batches. At the
end one pass over the runs gives every line to drop.

All steps are DataFrame operations. Lines are counted per batch with map-side
partial sums, so a line found in a third of all documents is a handful of rows
per task; the join that looks up each line's verdict is a plain equi-join with
unique keys on one side, which adaptive execution splits where a line is hot.

Defined results: null or empty text is one empty line; rows that repeat both id
and text are one document for counting and each comes back; documents with a null
id count like others, and come last in the order of ids; an empty table gives no
rows; only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, pinned, query, table, write_out

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends; its case is folded before."""
    return F.btrim(line, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id, pos, h1, h2) of each line whose key is long enough."""
    d = docs.select(*doc_key(), F.col("doc_id"), F.posexplode(lines_of(ascii_lower(F.col("text")))).alias("pos", "line"))
    d = d.select("k1", "k2", "doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return d.select("k1", "k2", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _batch_bounds(docs: DataFrame, n: int) -> list:
    """Ids that split the documents into n batches of about equal size."""
    at = [i / n for i in range(1, n)]
    found = docs.select(F.percentile_approx("doc_id", at, 1000).alias("p")).first()["p"] if at else None
    return sorted(set(found or []))


class LineRuns:
    """The levelled index. Runs are files in the shared folder, hash-partitioned
    and sorted by line hash."""

    def __init__(self, min_docs: int, fan_out: int):
        self.min_docs, self.fan_out, self.levels = min_docs, fan_out, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    @staticmethod
    def _store(rows: DataFrame) -> DataFrame:
        return write_out(rows.sortWithinPartitions("h1", "h2"), "line-run")

    def add(self, batch: DataFrame) -> None:
        """batch: one row for each (document, line hash)."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            own = own.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(0, self._store(own))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            together = self.levels[level][0]
            for other in self.levels[level][1:]:
                together = together.unionByName(other)
            self.levels[level] = []
            self._push(level + 1, self._store(self._merged(together)))

    def repeated(self) -> DataFrame:
        """(h1, h2, keep_doc) of each line found in enough documents."""
        runs = self.runs()
        rows = runs[0]
        for other in runs[1:]:
            rows = rows.unionByName(other)
        return self._merged(rows).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", F.col("max_doc").alias("keep_doc"))


def lines_to_drop(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """(k1, k2, drops): the positions of the lines that each document loses."""
    docs = docs.select("doc_id", "text")
    bounds = _batch_bounds(docs, batches)
    batch = F.lit(0)
    for b in bounds:  # batch 0 holds the largest ids; a null id is below all
        batch = batch + F.when(F.col("doc_id") > F.lit(b), 0).otherwise(1)
    lines = write_out(long_lines(docs, min_chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(min_docs, fan_out)
    for b in range(len(bounds) + 1):
        once = lines.where(F.col("batch") == b).groupBy("h1", "h2", "k1", "k2").agg(F.first("doc_id").alias("doc_id"))
        runs.add(once)
    # stored, so that both sides of the join are shuffled for it alone and adaptive
    # execution can split the rows of a hot line
    repeated = write_out(runs.repeated(), "repeated-lines")
    drop = lines.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    return drop.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with n_lines, n_dropped and
    kept_text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key())
    drops = lines_to_drop(docs, **params)
    d = pinned(rows.join(drops, ["k1", "k2"], "left"), lines=lines_of(F.col("row.text")))
    d = pinned(d, kept_at=F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>"))))
    kept = F.when(F.col("drops").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform("kept_at", lambda i: F.get("lines", i)), "\n"))
    return d.select("row", F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept_at")).cast("long").alias("n_dropped"), kept.alias("kept_text"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.keep_doc) AS dropped
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op4_line_runs", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
