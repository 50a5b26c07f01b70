"""Content store: page texts and documents as files.

The reference keeps one object per path in a bucket. Here the store is a keyed
table of immutable batches (``merge_store``) with one row per object path, in
hash buckets of the path's domain: an upsert writes its own rows only, a batch
with a token that was written before replaces itself, a read takes each path's
newest content. Listing reads one bucket's paths, never the text. Documents can
also be written as plain text files, one folder per (domain, job folder, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge_store import MergeStore

PARTITIONS = ["domain_key", "job_folder"]
CONTENT = "path string, domain_key string, job_folder string, content string"


def _with_partitions(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Domain and job folder of a 'domains/<domain>/jobs/<folder>/...' path."""
    parts = F.split(F.col(path_col), "/", -1)
    return df.withColumn("domain_key", F.get(parts, F.lit(1))).withColumn("job_folder", F.get(parts, F.lit(3)))


def content_store(spark: SparkSession, root: str, buckets: int = 256) -> MergeStore:
    """The store at ``root``; its domain and job folder follow from a path, so the
    key is the path alone in effect."""
    return MergeStore(spark, root, CONTENT, ["path", *PARTITIONS], ["domain_key"], buckets)


def upsert_content(spark: SparkSession, new: DataFrame, root: str, token: str | None = None) -> None:
    """A4: write (path, content) rows; a path already stored is replaced
    ("upsert"). The write is in proportion to the new rows. Of rows that repeat a
    path in one write, the one with the greatest content is stored."""
    content_store(spark, root).upsert(_with_partitions(new.select("path", "content")), token)


def delete_content(spark: SparkSession, paths: DataFrame, root: str, token: str | None = None) -> None:
    """Remove the objects at these paths, if they are there."""
    content_store(spark, root).delete(_with_partitions(paths.select("path")), token)


def read_content(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every stored object."""
    return content_store(spark, root).read().select("path", "content")


def list_content(spark: SparkSession, root: str, folder: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A4 listing: object paths under a folder prefix, by path, with limit and
    offset (the paging is the feature). One bucket is read when the folder names a
    domain."""
    store, parts = content_store(spark, root), folder.strip("/").split("/")
    named = len(parts) >= 2 and parts[0] == "domains"
    buckets = store.buckets_of(spark.createDataFrame([(parts[1],)], "domain_key string")) if named else None
    df = store.read(buckets=buckets, columns=[])
    if named:
        df = df.filter(F.col("domain_key") == parts[1])
    if len(parts) >= 4:
        df = df.filter(F.col("job_folder") == parts[3])
    df = df.filter(F.col("path").startswith(folder.rstrip("/") + "/")).select("path").orderBy("path")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def load_content(versions: DataFrame, content: DataFrame, path_col: str, out: str = "content") -> DataFrame:
    """A5: versions joined to their stored text by path; a missing object
    reads as ''."""
    c = content.select(F.col("path").alias(path_col), F.col("content").alias(out))
    return versions.join(c, path_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def write_documents(docs: DataFrame, root: str) -> None:
    """Each non-NULL document as text under
    root/domain_key=<d>/job_folder=<f>/kind=<k>/ (documents with NULL content
    make no file and no artifact row). ``docs``: path, kind, content."""
    d = _with_partitions(docs.filter(F.col("content").isNotNull()).select("path", "kind", "content"))
    (d.repartition(*PARTITIONS, "kind").select(*PARTITIONS, "kind", "content").write.mode("overwrite")
      .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS, "kind").text(root))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """A5 from files: (domain_key, job_folder, kind, content) of what
    ``write_documents`` wrote, each file read whole. Filters on the first three
    prune folders."""
    d = spark.read.schema("value string, domain_key string, job_folder string, kind string").text(root, wholetext=True)
    return d.select(*PARTITIONS, "kind", F.regexp_replace("value", r"\n\z", "").alias("content"))


def append_versions(versions: DataFrame, root: str, batch: str) -> None:
    """Append a batch of version rows. A batch that is written again (a
    retried job) replaces its own rows."""
    (versions.withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(root))
