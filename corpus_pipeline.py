"""A training-data pipeline: quality filter, line deduplication, near-duplicate
removal, benchmark decontamination, packing. Each stage works on what the stage
before it kept; results are written as Parquet and read again in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.llm import decontaminate, line_dedup, lsh_forest, mil_quality, packing
from sitegrove.llm.common import held_out, table, write_out

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the
    labels of the learning folds; if those don't hold documents of both kinds,
    nothing is rejected."""
    model = mil_quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return docs if isinstance(model, float) else mil_quality.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars, where there is such a
    column, follows a changed text. A document that loses all lines stays, empty."""
    d = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    types = dict(docs.dtypes)
    return d.select(*[(F.when(changed, new[c].cast(types[c])).otherwise(F.col(f"row.`{c}`")) if c in new else F.col(f"row.`{c}`")).alias(c)
                      for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return lsh_forest.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences of tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]

# the classifier, the forest and the packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
