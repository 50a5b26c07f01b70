"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later steps start
    from files that survive a lost executor, with a plan of their own."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("error")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128-bit identity of a document: its id and its text. Rows that repeat
    both are one document; nulls need no special join."""
    a, b = F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000null")), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(a, b).alias("k1"), F.xxhash64(F.lit("second"), b, a).alias("k2")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the engine's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``, equals ``remainder``.
    A null id is hashed as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def pinned(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with the computed columns, evaluated once: a generator keeps the
    optimizer from copying them into every place (and lambda) that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


# name -> (builder, oracle SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco
