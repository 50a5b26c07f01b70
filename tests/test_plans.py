"""Plan-shape checks for the scale properties the README claims."""

import re

from pyspark.sql import functions as F

from sitegrove.operators import catalog as C
from sitegrove.operators import changes as G
from sitegrove.operators import jobstate as J
from sitegrove.plans.q_events import event_pipeline
from sitegrove.sources import derived as D
from sitegrove.sources.tables import read_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top1_is_an_aggregate_not_a_window(spark, sf_small):
    p = _plan(C.latest_version_per_page(D.page_versions(spark, sf_small), ["id", "created_at"]))
    assert "Window" not in p and ("Aggregate" in p)


def test_ready_trigger_windows_are_split_by_bucket(spark, sf_small):
    p = _plan(J.ready_triggers(event_pipeline(spark, sf_small)["events"]))
    # every window over the events is keyed by (job, bucket); the only per-job
    # window runs over the small per-bucket totals
    specs = re.findall(r"windowspecdefinition\(([^,]+), ([^,]+),", p)
    assert specs and all("bucket" in b or "bucket" in a for a, b in specs)


def test_top_k_uses_partial_group_limit(spark, sf_small):
    p = _plan(C.first_pages(D.page_versions(spark, sf_small, with_page=True), 10))
    assert "WindowGroupLimit" in p


def test_spread_keeps_pushdown_and_pruning(spark, sf_small):
    df = read_table(spark, sf_small, "documents").filter(F.col("lang") == "en").select("doc_id")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_no_forced_broadcast_or_cross_join(spark, sf_small):
    import inspect

    import sitegrove
    import pkgutil
    for m in pkgutil.walk_packages(sitegrove.__path__, "sitegrove."):
        if m.name.startswith("sitegrove.llm"):
            continue  # has its own tests; broadcasts only what it has counted
        src = inspect.getsource(__import__(m.name, fromlist=["x"]))
        assert "crossJoin(" not in src and "F.broadcast(" not in src and "localCheckpoint" not in src, m.name
