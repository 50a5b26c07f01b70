"""The version pipeline as a stream, with late versions.

``version_batches`` gives a ``foreachBatch`` function over a merge-on-read table
of decided versions (``sources.merge_store``). A micro-batch reads the table's
buckets of its own pages only. It puts its versions into their pages' order,
wherever they belong: a version that now follows another one than before, or
whose predecessor came again, is decided anew, and the new row takes the old
one's place. Against cleaned text that ends with the direct successor. Against
stored text (``operators.stored``) a changed decision can change the next one: the
table keeps each version's two possible outcomes, so the whole cascade is one
scan over narrow rows, and only versions whose predecessor's stored form really
changed are diffed again.

The table after any order of arrival, in any cut into micro-batches, equals the
batch pipeline's result. A replayed batch doesn't see its own rows and replaces
them. Small batches are compacted as the table's tiers fill up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import changes as G
from ..operators.stored import differs, two_state_scan
from ..operators.text_ops import clean_pipeline
from ..operators.versions import VERSION_COLUMNS, version_rows
from ..session import ensure_checkpoint_dir
from ..sources.merge_store import MergeStore

VERSION_BUCKETS = 256


def _schema(key: str) -> str:
    return (f"id long, {key} long, seq long, prev_id long, cleaned_md string, stored_md string, additions long, deletions long, unchanged long, "
            "has_changes boolean, change_percentage double, is_new boolean, importance smallint, reason string, title string, description string, "
            "summary string, prev_enhanced boolean, f0 boolean, f1 boolean")


def version_table(spark: SparkSession, path: str, key: str = "page_id", buckets: int = VERSION_BUCKETS) -> MergeStore:
    return MergeStore(spark, path, _schema(key), ["id", key], [key], buckets)


def read_versions(spark: SparkSession, path: str, key: str = "page_id", buckets: int = VERSION_BUCKETS) -> DataFrame:
    """The decided versions, one row each."""
    return version_table(spark, path, key, buckets).read().drop("f0", "f1")


def version_batches(path: str, key: str = "page_id", against: str = "cleaned", scores: DataFrame | None = None,
                    buckets: int = VERSION_BUCKETS, extract_main: bool = True, fanout: int = 8):
    """The ``foreachBatch`` function: (batch of id, ``key``, seq, text; batch id).
    ``against``: 'cleaned' or 'stored'. ``scores``: optional (id, response). A
    version id that comes again replaces the earlier one."""
    if against not in ("cleaned", "stored"):
        raise ValueError("against must be 'cleaned' or 'stored'")

    def score(d: DataFrame) -> DataFrame:
        if scores is None:
            return d.withColumn("_score", F.lit(3))
        d = d.join(scores.select("id", F.col("response").alias("_resp")), "id", "left")
        return d.withColumn("_score", G.parse_score(F.col("_resp"))).drop("_resp")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        table, token = version_table(spark, path, key, buckets), f"batch-{batch_id}"
        rows = batch.groupBy("id").agg(F.max(F.struct(key, "seq", "text")).alias("_r")).select("id", "_r.*")  # an id once
        new = clean_pipeline(rows, "text", "cleaned_md", extract_main=extract_main).drop("text").checkpoint()
        pages = new.select(key).distinct()
        old = (table.read(buckets=table.buckets_of(pages), before=token).join(pages, key, "left_semi").join(new.select("id"), "id", "left_anti"))
        texts = new.select("id", "cleaned_md").unionByName(old.select("id", "cleaned_md"))

        narrow = old.select("id", key, "seq", F.col("prev_id").alias("_was"), F.coalesce("prev_enhanced", F.lit(False)).alias("_was_rich"), "f0", "f1",
                            F.lit(False).alias("_new"))
        nothing = F.lit(None).cast("boolean")
        order = narrow.unionByName(new.select("id", key, "seq", F.lit(None).cast("long").alias("_was"), F.lit(False).alias("_was_rich"),
                                              nothing.alias("f0"), nothing.alias("f1"), F.lit(True).alias("_new")))
        order = G.previous_version(order, key, ["seq", "id"], ["id", "_new"])
        moved = F.col("_new") | F.coalesce("prev__new", F.lit(False)) | ~F.col("prev_id").eqNullSafe(F.col("_was"))
        order = order.withColumn("_moved", moved).checkpoint()

        def with_texts(d: DataFrame) -> DataFrame:
            before = texts.select(F.col("id").alias("prev_id"), F.col("cleaned_md").alias("prev_cleaned_md"))
            return score(d.join(texts, "id").join(before, "prev_id", "left"))

        plain, own = F.col("prev_cleaned_md"), F.col("cleaned_md")
        if against == "cleaned":
            redo = with_texts(order.where("_moved").withColumn("prev_enhanced", F.lit(False)))
        else:
            m = with_texts(order.where("_moved").select("id", "prev_id"))
            gets = F.col("prev_id").isNull() | (F.col("_score") >= 2)
            both = m.select("id", (gets & (F.col("prev_id").isNull() | differs(plain, own))).alias("_f0"),
                            (gets & (F.col("prev_id").isNull() | differs(TX.enhance_content(plain), own))).alias("_f1"))
            known = order.join(both, "id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in ("f0", "f1")}).drop("_f0", "_f1")
            states = two_state_scan(known, key, ["seq", "id"], "prev_enhanced")
            redo = with_texts(states.where(F.col("_moved") | (F.col("prev_enhanced") != F.col("_was_rich"))))
        redo = redo.withColumn("_old", F.when(F.col("prev_enhanced"), TX.enhance_content(plain)).otherwise(plain))
        decided = version_rows(G.change_decision(G.diff_versions(redo, "_old", "cleaned_md"), F.col("_score")))
        table.upsert(decided.select("id", key, "seq", *VERSION_COLUMNS, "prev_enhanced", "f0", "f1"), token)
        table.compact(fanout)
    return run
