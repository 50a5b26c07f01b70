"""The merge-on-read store against a dict: upserts, deletes, replay, two writers,
compaction, reads as of a version."""

import glob
import os
import random
import tempfile

import pytest

from sitegrove.sources.merge_store import Conflict, MergeStore

SCHEMA = "k long, part string, v string"


def _store(spark, **kw):
    return MergeStore(spark, tempfile.mkdtemp(prefix="sg-merge-", dir="/tmp") + "/t", SCHEMA, ["k", "part"], buckets=4, **kw)


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _content(df):
    return {(r.k, r.part): r.v for r in df.collect()}


def test_random_history(spark):
    rnd, model = random.Random(2), {}
    s, versions = _store(spark), {}
    assert _content(s.read()) == {} and s.compact() == 0
    for step in range(14):
        keys = [(rnd.choice([None, *range(8)]), rnd.choice("ab")) for _ in range(rnd.randint(1, 4))]
        if step % 4 == 3:
            v = s.delete(spark.createDataFrame(keys, "k long, part string"))
            for k in keys:
                model.pop(k, None)
        else:
            v = s.upsert(_rows(spark, [(*k, f"{step}") for k in keys]))
            model |= {k: f"{step}" for k in keys}
        versions[v] = dict(model)
        assert _content(s.read()) == model
        if step in (6, 13):
            assert s.compact(fanout=3) > 0
            assert _content(s.read()) == model and len(s.manifest()[1]) < 11
    for v, exp in versions.items():  # older manifests still read as they were
        assert _content(s.read(version=v)) == exp
    s.compact(everything=True)
    assert _content(s.read()) == model and len(s.manifest()[1]) == 1 and s.manifest()[1][0]["rows"] == len(model)
    assert s.vacuum(keep=1) > 5 and _content(s.read()) == model


def test_write_is_in_proportion_to_the_new_rows(spark):
    s = _store(spark)
    s.upsert(_rows(spark, [(i, "a", "x" * 50) for i in range(2000)]))
    before = set(glob.glob(s.root + "/data/*"))
    s.upsert(_rows(spark, [(5, "a", "new")]))
    new = [f for f in glob.glob(s.root + "/data/*") if f not in before]
    files = [f for d in new for f in glob.glob(d + "/bucket=*/*.parquet")]
    assert len(new) == 1 and len(files) == 1
    got = _content(s.read())
    assert got[5, "a"] == "new" and len(got) == 2000
    b = s.buckets_of(spark.createDataFrame([(5, "a")], "k long, part string"))
    assert len(b) == 1 and 0 < len(part := _content(s.read(buckets=b))) < 2000 and part[5, "a"] == "new"


def test_replay_replaces_its_own_batch(spark):
    s = _store(spark)
    s.upsert(_rows(spark, [(1, "a", "one"), (2, "a", "one")]), token="b1")
    s.upsert(_rows(spark, [(2, "a", "two")]), token="b2")
    s.upsert(_rows(spark, [(1, "a", "one again"), (3, "a", "x")]), token="b1")
    assert _content(s.read()) == {(1, "a"): "one again", (2, "a"): "two", (3, "a"): "x"}
    assert _content(s.read(before="b2")) == {(1, "a"): "one again", (3, "a"): "x"}
    assert _content(s.read(before="b1")) == {} and len(s.manifest()[1]) == 2


def test_two_writers(spark, monkeypatch):
    a = _store(spark)
    b = MergeStore(spark, a.root, SCHEMA, ["k", "part"], buckets=4)
    # b commits between a's reading of the manifest and a's commit
    load, done = a.manifest, []

    def late():
        out = load()
        if not done:
            done.append(b.upsert(_rows(spark, [(1, "a", "b's"), (2, "a", "b's")])))
        return out
    monkeypatch.setattr(a, "manifest", late)
    a.upsert(_rows(spark, [(1, "a", "a's")]))
    assert _content(b.read()) == {(1, "a"): "a's", (2, "a"): "b's"}
    with pytest.raises(Conflict):
        a._commit(0, [])
    # a batch that comes while a compaction runs stays
    merged, came = a._merged, []

    def busy(*args, **kw):
        if not came:
            came.append(b.upsert(_rows(spark, [(9, "a", "meanwhile")])))
        return merged(*args, **kw)
    monkeypatch.setattr(a, "_merged", busy)
    a.compact(everything=True)
    assert _content(b.read()) == {(1, "a"): "a's", (2, "a"): "b's", (9, "a"): "meanwhile"}


def test_a_failed_writer_leaves_nothing_to_read(spark):
    s = _store(spark)
    s.upsert(_rows(spark, [(1, "a", "x")]))
    s._write(_rows(spark, [(2, "a", "lost")]).selectExpr("*", "false _deleted"))  # it died before its commit
    assert _content(s.read()) == {(1, "a"): "x"} and s.vacuum() == 1
    assert len(os.listdir(s.root + "/data")) == 1


def test_repeated_keys_and_empty_batches(spark):
    s = _store(spark)
    s.upsert(_rows(spark, [(1, "a", "x"), (1, "a", "y"), (1, "a", None)]))
    s.upsert(_rows(spark, []))
    assert _content(s.read()) == {(1, "a"): "y"}
    s.delete(spark.createDataFrame([(7, "z"), (1, "a")], "k long, part string"))
    assert _content(s.read()) == {}
