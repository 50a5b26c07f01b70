"""A keyed table of immutable write batches, merged on read.

An upsert or a delete writes only its own rows: one folder of Parquet files for
each batch, partitioned by a hash bucket of the key. A manifest, a small text file
with one line a live folder, is the commit: version n+1 is created only if nobody
else has, so of two writers the second takes the first's folders over and tries
again. A batch with a token that is already in the manifest replaces that batch
(a retried job, a replayed micro-batch) and keeps its place in the order.

A read takes the newest row of each key; a delete is a row too. The oldest,
largest folder is only anti-joined with the keys that newer batches touch, so its
contents are not shuffled for the merge; the newer ones are reduced by key.
Compaction is size-tiered: neighbouring folders of about one size become one, so
a row is rewritten a logarithmic number of times; deletes go when the oldest
folder takes part. Folders that no manifest names are left by a failed writer or
by a compaction; ``vacuum`` removes them.

The manifest has a line for each live batch (logarithmic in the batches under
regular compaction) and is the only thing the driver reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEAD = "_deleted"


class Conflict(Exception):
    """Another writer made this manifest version."""


class MergeStore:
    """``schema``: the columns of a row; ``key``: those that identify it;
    ``bucket_by``: the key columns that a read can be pruned by (default: all)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: list[str], bucket_by: list[str] | None = None,
                 buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.bucket_by = bucket_by or key
        self.stored = T.StructType([*self.schema.fields, T.StructField(DEAD, T.BooleanType())])

    # ------------------------------------------------------------- manifest
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _load(self, version: int) -> list[dict]:
        rows = self.spark.read.text(f"{self.root}/manifest/{version:012d}.json", wholetext=True).collect()
        return [json.loads(line) for line in rows[0].value.splitlines() if line] if rows else []

    def manifest(self) -> tuple[int, list[dict]]:
        """(version, live batches: folder, token, seq, rows), oldest first."""
        versions = self._versions()
        return (versions[-1], self._load(versions[-1])) if versions else (0, [])

    def _commit(self, version: int, batches: list[dict]) -> None:
        """Creates the manifest after ``version``; Conflict if it is there."""
        fs, p = self._fs(f"{self.root}/manifest/{version + 1:012d}.json")
        # the text goes to a name of its own first; taking the real name is the commit
        _, tmp = self._fs(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray("\n".join(json.dumps(b) for b in batches).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise Conflict(version + 1)

    # ---------------------------------------------------------------- write
    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> tuple[str, int]:
        folder = f"batch-{uuid.uuid4().hex}"
        d = df.select(*self.stored.fieldNames()).withColumn("bucket", self._bucket())
        d.repartition("bucket").sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return folder, self._files(folder).count()

    def _add(self, df: DataFrame, token: str | None, tries: int = 20) -> int:
        # of rows that repeat a key in one batch the greatest stays
        rest = [c for c in self.stored.fieldNames() if c not in self.key]
        folder, rows = self._write(df.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.key, "_r.*"))
        new = {"folder": folder, "token": token, "rows": rows}
        for _ in range(tries):
            version, live = self.manifest()
            at = next((i for i, b in enumerate(live) if token is not None and b["token"] == token), None)
            if at is None:
                batches = [*live, new | {"seq": max((b["seq"] for b in live), default=0) + 1}]
            else:
                batches = [*live[:at], new | {"seq": live[at]["seq"]}, *live[at + 1:]]
            try:
                self._commit(version, batches)
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers came first")

    def upsert(self, rows: DataFrame, token: str | None = None) -> int:
        """Adds or replaces rows by key. The manifest version that holds them."""
        return self._add(rows.select(*self.schema.fieldNames(), F.lit(False).alias(DEAD)), token)

    def delete(self, keys: DataFrame, token: str | None = None) -> int:
        """Removes the rows with these keys, if they are there."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
        return self._add(keys.select(*self.key, *none, F.lit(True).alias(DEAD)), token)

    # ----------------------------------------------------------------- read
    def _files(self, *folders: str) -> DataFrame:
        schema = T.StructType([*self.stored.fields, T.StructField("bucket", T.IntegerType())])
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{f}").parquet(f"{self.root}/data/{f}") for f in folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _merged(self, batches: list[dict], buckets: list[int] | None, drop_dead: bool, columns: list[str] | None = None) -> DataFrame:
        """The newest row of each key in ``batches``, oldest first."""
        names = [c for c in self.stored.fieldNames() if columns is None or c in (*self.key, *columns, DEAD)]

        def scan(b: dict) -> DataFrame:
            d = self._files(b["folder"])
            return (d.where(F.col("bucket").isin(buckets)) if buckets is not None else d).select(*names)
        base, newer = scan(batches[0]), batches[1:]
        if newer:
            rest = [c for c in names if c not in self.key]
            tagged = scan(newer[0]).withColumn("_seq", F.lit(newer[0]["seq"]).cast("long"))
            for b in newer[1:]:
                tagged = tagged.unionByName(scan(b).withColumn("_seq", F.lit(b["seq"]).cast("long")))
            top = tagged.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(*self.key, "_r.*") if len(newer) > 1 else tagged.select(*names)
            same = None
            touched = tagged.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
            for k in self.key:
                same = F.col(k).eqNullSafe(F.col(f"_k_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            base = base.join(touched, same, "left_anti").select(*names).unionByName(top.select(*names))
        return base.where(~F.col(DEAD)) if drop_dead else base

    def read(self, version: int | None = None, buckets: list[int] | None = None, before: str | None = None,
             columns: list[str] | None = None) -> DataFrame:
        """The rows as of a manifest version (default: the last). ``buckets``: only
        these are read. ``columns``: only the key and these. ``before``: leave out the batch with this token and all
        after it, as a replayed batch must see the table."""
        live = self.manifest()[1] if version is None else self._load(version)
        at = next((i for i, b in enumerate(live) if before is not None and b["token"] == before), len(live))
        if not live[:at]:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(live[:at], buckets, True, columns).drop(DEAD)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys (at most ``buckets`` numbers)."""
        return sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())

    # ------------------------------------------------------------- compact
    def _run_to_merge(self, live: list[dict], fanout: int) -> tuple[int, int] | None:
        """The first stretch of at least ``fanout`` neighbours of one size tier."""
        def tier(b: dict) -> int:
            t, rows = 0, max(1, b["rows"])
            while rows >= fanout:
                rows //= fanout
                t += 1
            return t
        i = 0
        while i < len(live):
            j = i
            while j < len(live) and tier(live[j]) == tier(live[i]):
                j += 1
            if j - i >= fanout:
                return i, j
            i = j
        return None

    def compact(self, fanout: int = 4, everything: bool = False) -> int:
        """Merges stretches of neighbouring batches of about one size until there
        is none (``everything``: all into one). The number of merges. Batches that
        come meanwhile stay behind the merged ones; if what was merged itself
        changed (a replay), the merge is dropped."""
        merges = 0
        while True:
            version, live = self.manifest()
            span = ((0, len(live)) if len(live) > 1 else None) if everything else self._run_to_merge(live, fanout)
            if span is None:
                return merges
            part = live[span[0]:span[1]]
            folder, rows = self._write(self._merged(part, None, drop_dead=span[0] == 0))
            one = {"folder": folder, "token": None, "seq": part[-1]["seq"], "rows": rows}
            while True:
                names = [b["folder"] for b in live]
                at = next((i for i in range(len(live)) if names[i:i + len(part)] == [b["folder"] for b in part]), None)
                if at is None:
                    break
                try:
                    self._commit(version, [*live[:at], one, *live[at + len(part):]])
                    break
                except Conflict:
                    version, live = self.manifest()
            merges += 1

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests before the last ``keep`` and the folders that no kept
        one names. Only when no writer is at work: its folder has no manifest yet."""
        versions = self._versions()
        kept, old = versions[-keep:], versions[:-keep]
        named = {b["folder"] for v in kept for b in self._load(v)}
        fs, p = self._fs(f"{self.root}/data")
        gone = 0
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
                gone += 1
        for v in old:
            fs.delete(self._fs(f"{self.root}/manifest/{v:012d}.json")[1], False)
        return gone
