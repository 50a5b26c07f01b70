"""Version decisions against the previously *stored* text (SURVEY Q4,
``against='stored'``).

What is stored for a version is its cleaned text, or the enhanced text when the
change was scored 2 or more. The next version is compared with that, so each
decision rests on the one before it. But a stored text has only two forms: for
each version it is enough to know whether it would be enhanced if its predecessor
was stored plain (``f0``) and if it was stored enhanced (``f1``). That makes a
version a function from one bit to one bit, and functions compose in any
grouping: ``two_state_scan`` finds every state with running window sums instead
of one step a version, and cuts the versions of a large page into pieces that are
scanned apart and joined by one row each.

Whether two texts differ for the decision needs no line diff: counts are of
newlines, so there is no change if and only if both texts agree up to their last
newline. The diff itself then runs once a version, against the text that was
really stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from . import changes as G
from .text_ops import clean_pipeline
from .versions import version_rows


def differs(old: Column, new: Column) -> Column:
    """Whether the line diff of two texts would count any change (G2's
    has_changes): all but the last line, with its newlines, are unequal."""
    o, n = G.diff_normalize_cols(old, new)

    def but_last(t):
        return F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "\n", -1)))
    return but_last(o) != but_last(n)


def _running(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Adds _n (inversions so far) and _r (at the last version whose result does
    not depend on its predecessor: that result, and _n there)."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_n", F.sum((F.col("f0") & ~F.col("f1")).cast("long")).over(w))
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("s"), F.col("_n").alias("n")))
    return d.withColumn("_r", F.last(fixed, ignorenulls=True).over(w))


def _after(start: Column) -> Column:
    """The state after a row of ``_running``, from the state before its part."""
    odd = (F.col("_n") - F.coalesce("_r.n", F.lit(0))) % 2 == 1
    return F.coalesce("_r.s", start) != odd


def two_state_scan(df: DataFrame, key: str, order: list[str], out: str, task_rows: int = 100_000) -> DataFrame:
    """``df`` with the boolean ``out``: the state before each row. Rows of a key in
    the order of ``order`` (the last column unique in a key) map the state before
    to the state after, false to ``f0`` and true to ``f1``; a key starts with
    false. Keys of more than ``task_rows`` rows (counted first) are numbered by a
    global sort and scanned in pieces of that many rows."""
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > task_rows).select(key)
    if large.isEmpty():
        return _scanned(df, [key], order, F.lit(False), out)
    rows = G.numbered(df.select(key, *order, "f0", "f1").join(large, key, "left_semi"), [key, *order], "_i")
    rows = rows.withColumn("_b", F.expr(f"_i div {int(task_rows)}"))
    # a piece as a function: what it makes of false and of true
    end = _running(rows, [key, "_b"], ["_i"]).groupBy(key, "_b").agg(F.max_by(F.struct("_n", "_r"), "_i").alias("_e")).select(key, "_b", "_e.*")
    pieces = end.select(key, "_b", _after(F.lit(False)).alias("f0"), _after(F.lit(True)).alias("f1"))
    starts = _scanned(pieces, [key], ["_b"], F.lit(False), "_start").select(key, "_b", "_start")
    states = _scanned(rows.join(starts, [key, "_b"]), [key, "_b"], ["_i"], F.col("_start"), out)
    states = states.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in order], out)
    same = F.col(key) == F.col("_k")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    spread = df.join(large, key, "left_semi").join(states, same).select(*df.columns, out)
    return _scanned(df.join(large, key, "left_anti"), [key], order, F.lit(False), out).unionByName(spread)


def _scanned(df: DataFrame, part: list[str], order: list[str], start: Column, out: str) -> DataFrame:
    d = _running(df, part, order).withColumn("_s", _after(start))
    before = F.lag("_s").over(Window.partitionBy(*part).orderBy(*order))
    return d.withColumn(out, F.coalesce(before, start)).select(*df.columns, out)


def stored_versions(chain: DataFrame, key: str = "page_id", seq: str = "seq", text: str = "text", id_col: str = "id",
                    title: str | None = None, scores: DataFrame | None = None, enhanced: DataFrame | None = None,
                    extract_main: bool = True, with_diff_text: bool = False, task_rows: int = 100_000) -> DataFrame:
    """``process_versions`` with each version compared with the stored text of the
    version before it. ``scores``: optional (id, response); ``enhanced``: optional
    (id, enhanced) results of an enhancer (NULL or missing: it failed, the cleaned
    text is stored), else the deterministic one. Adds ``prev_enhanced``: whether
    the text compared with was an enhanced one."""
    cols = [key, seq, id_col, text] + ([title] if title else [])
    c = clean_pipeline(chain.select(*cols), text, "cleaned_md", extract_main=extract_main).drop(text)
    if enhanced is not None:
        c = c.join(enhanced.select(F.col("id").alias(id_col), F.col("enhanced").alias("_enh")), id_col, "left")
    else:
        c = c.withColumn("_enh", TX.enhance_content(F.col("cleaned_md")))
    if scores is not None:
        c = c.join(scores.select(F.col("id").alias(id_col), F.col("response").alias("_resp")), id_col, "left")
        c = c.withColumn("_score", G.parse_score(F.col("_resp"))).drop("_resp")
    else:
        c = c.withColumn("_score", F.lit(3))
    c = G.previous_version(c, key, [seq, id_col], [id_col, "cleaned_md", "_enh"])
    first, gets = F.col(f"prev_{id_col}").isNull(), F.col("_enh").isNotNull()
    plain, rich = F.col("prev_cleaned_md"), F.coalesce("prev__enh", "prev_cleaned_md")
    states = c.select(F.col(key), F.col(seq), F.col(id_col),
                      *[(gets & (first | ((F.col("_score") >= 2) & differs(old, F.col("cleaned_md"))))).alias(f)
                        for f, old in (("f0", plain), ("f1", rich))])
    states = two_state_scan(states, key, [seq, id_col], "prev_enhanced", task_rows).select(F.col(id_col), "prev_enhanced")
    c = c.join(states, id_col).withColumn("_old", F.when(F.col("prev_enhanced"), rich).otherwise(plain))
    d = G.diff_versions(c, "_old", "cleaned_md", with_text=with_diff_text)
    if id_col != "id":
        d = d.withColumnRenamed(f"prev_{id_col}", "prev_id")
    d = version_rows(G.change_decision(d, F.col("_score")), title, enhanced=F.col("_enh"))
    keep = [id_col, key, seq, "prev_id", "prev_enhanced", "cleaned_md", "stored_md", "additions", "deletions", "unchanged", "has_changes",
            "change_percentage", "is_new", "importance", "reason", "title", "description", "summary"]
    return d.select(*keep, *(["diff_text"] if with_diff_text else []))
