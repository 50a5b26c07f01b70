"""Bounded, reproducible samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, y): ids of the learning folds with one label only; null ids, null
    labels and ids with conflicting labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    g = rows.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z"))
    return g.where(F.col("y") == F.col("z")).select("doc_id", F.col("y").cast("int").alias("y"))


def smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hash of their id: a fixed random sample."""
    return ids.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(n)


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sample's texts, one for each id (the least, if an id has several). The
    sample is bounded by its size parameter, so it is broadcast."""
    d = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return d.groupBy(*ids.columns).agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
