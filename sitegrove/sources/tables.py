"""Readers for the given parquet tables.

Only ``spark.read.parquet`` is used, so Catalyst prunes columns and pushes
filters into the scan of every query built on top (both pass through the
optional round-robin repartition below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# tables whose rows carry text that is parsed or cleaned per row, or (lineitem)
# that feed page rows built per row before the first shuffle: CPU-heavy map
# work worth spreading. Small numeric tables stay as their files give them.
SPREAD_TABLES = {"documents", "pages", "conversations", "events", "benchmark", "lineitem"}


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all task slots when its files give fewer splits
    than the cluster has (a large file written as a single row group cannot
    be split). At scale a table has many files and this is a no-op; it never
    changes results, and filters and column pruning still reach the scan
    below the round-robin exchange."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


# rows of a shuffled table that one task is given: some 1 kB each with a page's texts
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks to deal ``rows`` rows over: a task's share stays the same
    however large the table grows, where adaptive execution would join small
    compressed partitions into tasks of gigabytes."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files give it, for a caller that deals its rows itself."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = raw_table(spark, sf_dir, name)
    return spread(df) if name in SPREAD_TABLES else df
