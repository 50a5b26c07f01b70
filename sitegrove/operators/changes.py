"""Change detection over version chains.

Plan:
1. ``previous_version`` pairs each version with the one before it: one window
   on the page key, with pages of very many versions paired by their place in
   a global order instead.
2. Pairs whose normalised texts are identical, and first versions, never
   reach Python: their counts are constants. Only changed pairs go through the
   line diff, an Arrow-batched pandas UDF (map-side, evaluated once per row) that
   works on whole rows of the length table as bits of one number.
3. Decision, gate and version rows are column expressions.
"""

from __future__ import annotations

from bisect import bisect_left
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.scalars import js_round

# --------------------------------------------------------------------------- C7

def previous_version(df: DataFrame, key: str, order: list[str], cols: list[str],
                     task_rows: int = 10_000) -> DataFrame:
    """Adds ``prev_<c>`` for each c in ``cols``: the value of the latest
    earlier version of the same ``key`` (NULL for the first), in the order of
    the columns ``order``, of any type, of which the last is unique in a key.

    Keys of at most ``task_rows`` versions (counted first, map-side) are a window
    each. Larger ones are sorted globally, which spreads a key over tasks, and
    paired by their number in that order.
    """
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > task_rows).select(key)
    if large.isEmpty():
        return _lagged(df, key, order, cols)
    small = df.join(large, key, "left_anti")
    return _lagged(small, key, order, cols).unionByName(_paired_by_number(df.join(large, key, "left_semi"), key, order, cols))


def _lagged(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    return d.withColumns({f"prev_{c}": F.col(f"_p.{c}") for c in cols}).drop("_p")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """The distinct-ordered rows of ``df`` with their number 0, 1, 2, ... in the
    global order. Rows are range-partitioned and sorted; a partition's numbers
    start after those of the partitions before it (one row each)."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_g", F.monotonically_increasing_id())
    d = d.checkpoint().withColumn("_part", F.shiftright("_g", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (d.join(starts, "_part")
             .withColumn(out, F.col("_start") + F.col("_g").bitwiseAND((1 << 33) - 1)).drop("_part", "_g", "_start"))


def _paired_by_number(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    rows = numbered(df.select(key, *order), [key, *order], "_i")
    before = rows.select(F.col(key), (F.col("_i") + 1).alias("_i"), *[F.col(c).alias(f"_o_{c}") for c in order])
    pairs = rows.join(before, [key, "_i"]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in order],
                                                 *[f"_o_{c}" for c in order])

    def same(a, b):
        cond = F.col(key) == F.col("_k")
        for c in order:
            cond = cond & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
        return cond

    d = df.join(pairs, same("", "_c_"), "left").drop("_k", *[f"_c_{c}" for c in order])
    earlier = df.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_e_{c}") for c in order],
                        *[F.col(c).alias(f"prev_{c}") for c in cols])
    d = d.join(earlier, same("_o_", "_e_"), "left")
    return d.select(*df.columns, *[f"prev_{c}" for c in cols])


# --------------------------------------------------------------------------- G2/G4

def _tokens(text: str) -> list[str]:
    """Line tokens with their newline; the last line has none; '' -> []."""
    if not text:
        return []
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] != "" else [])


class _Suffixes:
    """Lengths of the longest common subsequence of all suffixes x[i:], y[j:]: one
    whole number a row, whose 0 bits mark where the length grows as j falls. A row
    is a few operations on m-bit numbers. Every ``step``-th row is kept, the rest
    are made again block by block, so memory is some 2 sqrt(n) rows."""

    def __init__(self, x: list[int], y: list[int]):
        self.x, self.n, self.m = x, len(x), len(y)
        places: dict[int, list[int]] = {}
        for j, t in enumerate(y):
            places.setdefault(t, []).append(self.m - 1 - j)
        self.masks = {t: sum(1 << p for p in ps) for t, ps in places.items()}
        self.full = (1 << self.m) - 1
        self.step = max(1, isqrt(self.n))
        self.kept, row = {self.n: self.full}, self.full
        for i in range(self.n - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def _above(self, i: int, row: int) -> int:
        u = row & self.masks.get(self.x[i], 0)
        return ((row + u) | (row - u)) & self.full

    def _row(self, i: int) -> int:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(i - i % self.step + self.step, self.n)
            self.block, row = {}, self.kept[end]
            for k in range(end - 1, i - i % self.step, -1):
                row = self.block[k] = self._above(k, row)
        return self.block[i]

    def length(self, i: int, j: int) -> int:
        k = self.m - j
        return k - (self._row(i) & ((1 << k) - 1)).bit_count()


def _shared(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of the items that the other side has too."""
    in_a, in_b = set(a), set(b)
    return [i for i, t in enumerate(a) if t in in_b], [j for j, t in enumerate(b) if t in in_a]


def _common_length(a: list[int], b: list[int]) -> int:
    keep_a, keep_b = _shared(a, b)
    x, y = [a[i] for i in keep_a], [b[j] for j in keep_b]
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
    return lo + hi + (_Suffixes(x, y).length(0, 0) if x and y else 0)


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of the longest common subsequence. Of several, the one that
    takes each item of ``a`` in turn if it can be part of one, at its next place in
    ``b``: a fixed rule, so a diff text has one right form."""
    keep_a, keep_b = _shared(a, b)
    x, y = [a[i] for i in keep_a], [b[j] for j in keep_b]
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    found = [(k, k) for k in range(lo)]
    x, y = x[lo:], y[lo:]
    if x and y:
        lengths, at = _Suffixes(x, y), {}
        for j, t in enumerate(y):
            at.setdefault(t, []).append(j)
        left, j = lengths.length(0, 0), 0
        for i, t in enumerate(x):
            if not left:
                break
            k = bisect_left(at[t], j) if t in at else 0
            if t in at and k < len(at[t]) and lengths.length(i + 1, at[t][k] + 1) == left - 1:
                j = at[t][k] + 1
                found.append((lo + i, lo + j - 1))
                left -= 1
    return [(keep_a[i], keep_b[j]) for i, j in found]


def line_diff(old: str, new: str, want_text: bool = False, count: str = "newlines") -> tuple[int, int, int, str | None]:
    """(additions, deletions, unchanged, diff_text). ``count``: 'newlines' counts
    newline characters, as the reference does, 'lines' counts lines. Small per-row
    helper."""
    ta, tb = _tokens(old), _tokens(new)
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(t, len(ids)) for t in x] for x in (ta, tb))
    pairs = _common(a, b) if want_text else None
    common = len(pairs) if want_text else _common_length(a, b)
    text = _render(pairs, ta, tb) if want_text else None
    if count == "lines":
        return len(tb) - common, len(ta) - common, common, text
    unchanged = common - (1 if ta and tb and ta[-1] == tb[-1] else 0)
    return new.count("\n") - unchanged, old.count("\n") - unchanged, unchanged, text


def _render(pairs: list[tuple[int, int]], ta: list[str], tb: list[str]) -> str:
    """Hunks in order, removals before additions inside a change run; each
    hunk (not line) is prefixed with '+ ', '- ' or two spaces."""
    out, same, i, j = [], [], 0, 0
    for p, q in [*pairs, (len(ta), len(tb))]:
        if p > i or q > j:
            if same:
                out.append("  " + "".join(same))
            same = []
            out += [mark + "".join(run) for mark, run in (("- ", ta[i:p]), ("+ ", tb[j:q])) if run]
        same += ta[p:p + 1]
        i, j = p + 1, q + 1
    return "".join(out) + ("  " + "".join(same) if same else "")


_DIFF = T.StructType([
    T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()),
    T.StructField("unchanged", T.LongType()), T.StructField("diff_text", T.StringType())])


def _diff_udf(want_text: bool, count: str):
    @F.pandas_udf(_DIFF)
    def diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = [line_diff(o or "", n or "", want_text, count) for o, n in zip(old, new)]
        return pd.DataFrame(rows, columns=["additions", "deletions", "unchanged", "diff_text"])
    return diff


def diff_versions(pairs: DataFrame, old: str, new: str, with_text: bool = False, count: str = "newlines") -> DataFrame:   # G1 + G2 (+G4)
    """Line-diff metrics for rows with both texts (G1 normalisation first).
    ``count``: 'newlines' (an edit to only the last line is no change, SURVEY Q5)
    or 'lines'.
    Rows with a NULL ``old`` (no previous version) get NULL metrics; pairs
    whose normalised texts are identical get constant metrics. Only changed
    pairs send their texts to the diff UDF (the others pass NULLs, so almost
    nothing crosses to Python for them), in one pass over the rows."""
    o, n = diff_normalize_cols(F.col(old), F.col(new))
    first = F.col(old).isNull()
    same = ~first & (o == n)
    need = ~first & (o != n)
    # a generator: filters on the results read its output, and don't run the UDF again
    pairs = pairs.select("*", F.inline(F.array(_diff_udf(with_text, count)(F.when(need, o), F.when(need, n)).cast(
        "struct<_da:bigint,_dd:bigint,_du:bigint,_dt:string>"))))
    nl = (F.length(n) - F.length(F.replace(n, F.lit("\n"), F.lit("")))).cast("long")
    if count == "lines":  # the last line has no newline
        nl = F.when(n == "", F.lit(0).cast("long")).otherwise(nl + 1)
    zero = F.lit(0).cast("long")
    add = F.when(first, F.lit(None).cast("long")).when(same, zero).otherwise(F.col("_da"))
    dele = F.when(first, F.lit(None).cast("long")).when(same, zero).otherwise(F.col("_dd"))
    unch = F.when(first, F.lit(None).cast("long")).when(same, nl).otherwise(F.col("_du"))
    text = (F.when(first, F.lit(None).cast("string"))
             .when(same, F.when(n == "", F.lit("")).otherwise(F.concat(F.lit("  "), n)))
             .otherwise(F.col("_dt"))) if with_text else F.lit(None).cast("string")
    out = pairs.withColumn("_a", add).withColumn("_d", dele).withColumn("_u", unch).withColumn("diff_text", text)
    total = F.col("_a") + F.col("_d") + F.col("_u")
    return (out.withColumn("additions", F.col("_a")).withColumn("deletions", F.col("_d"))
               .withColumn("unchanged", F.col("_u"))
               .withColumn("has_changes", (F.col("_a") > 0) | (F.col("_d") > 0))
               .withColumn("change_percentage",
                           F.when(total > 0, (F.col("_a") + F.col("_d")) / total * 100.0)
                            .when(total.isNotNull(), F.lit(0.0)))
               .drop("_a", "_d", "_u", "_da", "_dd", "_du", "_dt"))


def diff_normalize_cols(old: Column, new: Column) -> tuple[Column, Column]:
    return TX.diff_normalize(old), TX.diff_normalize(new)


# --------------------------------------------------------------------------- G3

def bag_diff(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """Line-multiset difference per pair (cheap upper layer; never flags moved
    lines). One pass over the pairs: both sides' lines (plus one empty marker
    so a pair of empty texts still appears) are exploded, counted per
    (pair, line) with map-side partial aggregation, and matched counts are
    min(old, new)."""
    def tagged(col, side):
        t = TX.diff_normalize(F.col(col))
        toks = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))
        return F.transform(toks, lambda l: F.struct(l.alias("line"), F.lit(side).alias("side")))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit(-1).alias("side")))
    x = pairs.select(*key, F.explode(F.concat(tagged(old, 0), tagged(new, 1), marker)).alias("e"))
    per_line = x.groupBy(*key, F.col("e.line").alias("line")).agg(
        F.count_if(F.col("e.side") == 0).alias("o"), F.count_if(F.col("e.side") == 1).alias("n"))
    agg = per_line.groupBy(*key).agg(
        F.sum(F.least("o", "n")).alias("bag_unchanged"),
        F.sum(F.col("o") - F.least("o", "n")).alias("bag_deletions"),
        F.sum(F.col("n") - F.least("o", "n")).alias("bag_additions"))
    return agg.select(*key, *[F.col(c).cast("long").alias(c) for c in ["bag_additions", "bag_deletions", "bag_unchanged"]])


# --------------------------------------------------------------------------- G6/G7/G8

def parse_score(text: Column) -> Column:
    """Trimmed response, integer prefix; out of 1..4 or unparsable -> 2;
    missing response text -> '2'."""
    t = F.coalesce(TX.js_trim(text), F.lit("2"))
    n = F.regexp_extract(t, r"^([+-]?[0-9]+)", 1).try_cast("long")
    return F.when(n.between(1, 4), n).otherwise(F.lit(2)).cast("int")


def change_decision(df: DataFrame, score: Column | None = None) -> DataFrame:     # G5 + G6
    """Adds is_new, importance, reason from the diff metrics. ``score`` is
    the parsed scorer output; without a scorer the score is 3."""
    sc = score if score is not None else F.lit(3)
    is_new = F.col("prev_id").isNull()
    unchanged = ~is_new & F.col("has_changes").isNotNull() & ~F.col("has_changes")
    no_diff = ~is_new & F.col("has_changes").isNull()
    importance = (F.when(unchanged, F.lit(None)).when(is_new, F.lit(4)).when(no_diff, F.lit(2)).otherwise(sc))
    reason = (F.when(unchanged, F.lit("No changes detected in diff")).when(is_new, F.lit("New page"))
              .when(no_diff, F.lit("No diff available"))
              .otherwise(F.concat(F.lit("Semantic importance: "), sc.cast("string"), F.lit("/4"))))
    return (df.withColumn("is_new", is_new)
              .withColumn("importance", importance.cast("smallint"))
              .withColumn("reason", reason))


def enhancement_gate(cleaned: Column, enhanced: Column) -> Column:                # G7
    """Stored text: enhanced when importance >= 2 (falls back to cleaned when
    the enhancer returned nothing), else the cleaned text."""
    return F.when(F.col("importance") >= 2, F.coalesce(enhanced, cleaned)).otherwise(cleaned)


# --------------------------------------------------------------------------- G10/G11

def similarity(a: Column, b: Column) -> Column:
    """0.3 * length ratio + 0.7 * token Jaccard of normalised texts;
    1 when equal, 0 when either is empty; 1 when both normalise to ''."""
    na, nb = TX.fingerprint_normalize(a), TX.fingerprint_normalize(b)
    la, lb = F.length(na), F.length(nb)
    length_sim = F.lit(1.0) - F.abs(la - lb) / F.greatest(la, lb)
    ta, tb = F.array_distinct(F.split(na, " ", -1)), F.array_distinct(F.split(nb, " ", -1))
    jac = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    score = length_sim * 0.3 + jac * 0.7
    return (F.when(a == b, F.lit(1.0))
             .when(F.coalesce(a, F.lit("")) == "", F.lit(0.0))
             .when(F.coalesce(b, F.lit("")) == "", F.lit(0.0))
             .when(F.greatest(la, lb) == 0, F.lit(1.0))
             .otherwise(score))


def changed_enough(sim: Column, threshold: Column) -> tuple[Column, Column]:       # G11
    changed = sim < threshold
    pct = js_round((F.lit(1.0) - sim) * 100).cast("long")
    reason = F.when(changed, F.concat(F.lit("Content changed by "), pct.cast("string"), F.lit("%"))) \
        .otherwise(F.concat(F.lit("Content similarity "), js_round(sim * 100).cast("long").cast("string"),
                            F.lit("% (above "), js_round(threshold * 100).cast("long").cast("string"),
                            F.lit("% threshold)")))
    return changed, reason


def profile_threshold(params: Column, default: float = 0.95) -> Column:
    return F.coalesce(F.get_json_object(params, "$.similarityThreshold").cast("double"), F.lit(default))


# --------------------------------------------------------------------------- D8

def change_breakdown(versions: DataFrame, key: str = "job_id") -> DataFrame:
    imp = F.col("importance")
    return versions.groupBy(key).agg(
        F.count_if(F.col("reason") == "New page").alias("new_pages"),
        F.count_if(imp.isNull()).alias("unchanged"),
        F.count_if(imp == 1).alias("minor"),
        F.count_if((imp >= 2) & (F.col("reason") != "New page")).alias("significant"))
