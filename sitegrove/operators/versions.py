"""Version processing (batch form of the per-page pipeline, S8 batch, G13).

chain (key, seq, raw text[, crawl title][, change status]) ->
  F15 clean (+F12 main content, +F13 metadata) -> C7 previous version ->
  G1/G2 diff -> G5/G6 decision (scores from a scorer response table, else 3) ->
  G7 stored text (F16 enhancement for importance >= 2) -> G14 title,
  F17 description/summary -> one version row per processed page.

Cleaning runs map-side before the only shuffle (the lag window on the page
key), so only cleaned text crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from . import changes as G
from .text_ops import clean_pipeline


def process_versions(chain: DataFrame, key: str = "page_id", seq: str = "seq", text: str = "text",
                     id_col: str = "id", title: str | None = None, scores: DataFrame | None = None,
                     extract_main: bool = True, with_diff_text: bool = False) -> DataFrame:
    """``scores``: optional (id, response) table of scorer outputs."""
    cols = [key, seq, id_col, text] + ([title] if title else [])
    c = clean_pipeline(chain.select(*cols), text, "cleaned_md", extract_main=extract_main).drop(text)
    c = G.previous_version(c, key, [seq, id_col], [id_col, "cleaned_md"])
    d = G.diff_versions(c, "prev_cleaned_md", "cleaned_md", with_text=with_diff_text)
    score = None
    if scores is not None:
        d = d.join(scores.select(F.col("id").alias(id_col), F.col("response").alias("_resp")), id_col, "left")
        score = G.parse_score(F.col("_resp"))
    out = version_rows(G.change_decision(d, score), title)
    keep = [id_col, key, seq, *VERSION_COLUMNS] + (["diff_text"] if with_diff_text else [])
    return out.select(*keep)


VERSION_COLUMNS = ["prev_id", "cleaned_md", "stored_md", "additions", "deletions", "unchanged", "has_changes",
                   "change_percentage", "is_new", "importance", "reason", "title", "description", "summary"]


def version_rows(d: DataFrame, title: str | None = None, enhanced: Column | None = None) -> DataFrame:
    """The stored text (G7) and display fields (G14, F17) of decided versions.
    ``enhanced``: the enhancer's result, else the deterministic one."""
    crawl_title = F.col(title) if title else F.lit(None).cast("string")
    rich = enhanced if enhanced is not None else TX.enhance_content(F.col("cleaned_md"))
    return (d.withColumn("stored_md", G.enhancement_gate(F.col("cleaned_md"), rich))
            .withColumn("title", F.coalesce(F.when(crawl_title != "", crawl_title), TX.extract_title(F.col("cleaned_md"))))
            .withColumn("description", TX.deterministic_description(F.col("cleaned_md")))
            .withColumn("summary", TX.deterministic_summary(F.col("cleaned_md"))))
