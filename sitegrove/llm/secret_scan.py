"""Secret scanning over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: the
parse tree is folded into the sets of strings a match must contain, as an OR of
ANDs of trigrams. The index holds, for every trigram that some rule needs, the
documents whose folded text contains it; a rule's candidates are the documents
that are in all postings of one of its conjunctions. Candidates are then verified
with the expression itself on the whole text. A rule without mandatory trigrams
scans every document.

All steps are DataFrame operations. Postings are rows (trigram, document); they
are intersected by counting per document and conjunction with map-side partial
counts, so a trigram found everywhere is never gathered in one place.

Defined results: a null text is an empty one and has no spans; rows that repeat
both id and text are one document in the index and each comes back; an empty table
gives no rows; only id and text are read, so other columns can have any name.
Spans are code points, end exclusive; matches of a rule are leftmost and do not
overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, pinned, query, table, write_out


@dataclass(frozen=True)
class Rule:
    """``group`` must match at least ``min_chars`` characters, or the match is
    dropped (a dropped match still uses up its characters)."""
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    base: bool = False


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
# A run of hex digits, or of key characters after AKIA, that is too short holds no
# longer one, so its least length can stand in the expression.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# ---- Boolean trigram queries: an OR (set) of ANDs (sets of trigrams) ----------
Query = frozenset
ALWAYS: Query = frozenset([frozenset()])
MAX_STRINGS = 64


def _least(q) -> Query:
    """Without conjunctions that contain another one."""
    q = frozenset(q)
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(a: Query, b: Query) -> Query:
    return _least(x | y for x, y in product(a, b)) if len(a) * len(b) <= MAX_STRINGS else (a if a != ALWAYS else b)


def _trigrams(strings) -> Query:
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _fold(items) -> tuple[frozenset | None, Query]:
    """(all strings the items can match, or None; query every match satisfies).
    Letters are folded to lower case, as the index is."""
    strings, need, whole = frozenset([""]), ALWAYS, True
    for op, arg in items:
        own, own_need = _node(str(op), arg)
        if own is not None and len(own) * len(strings) <= MAX_STRINGS:
            strings = frozenset(a + b for a in strings for b in own)
            continue
        need, whole = _and(need, _trigrams(strings)), False
        strings = own if own is not None else frozenset([""])
        need = _and(need, own_need)
    return (strings, _trigrams(strings)) if whole else (None, _and(need, _trigrams(strings)))


def _node(op: str, arg) -> tuple[frozenset | None, Query]:
    if op == "LITERAL":
        s = frozenset([chr(arg).lower() if arg < 128 else chr(arg)])
        return s, ALWAYS
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
        return frozenset(chr(v).lower() if v < 128 else chr(v) for _, v in arg), ALWAYS
    if op == "SUBPATTERN":
        return _fold(arg[3])
    if op == "BRANCH":
        parts = [_fold(p) for p in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MAX_STRINGS:
            both = frozenset().union(*[s for s, _ in parts])
            return both, _trigrams(both)
        return None, _least(c for _, q in parts for c in q)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, sub = arg
        strings, need = _fold(sub)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ALWAYS
        if least == most == 1:
            return strings, need
        return None, need if least else ALWAYS
    if op == "AT":
        return frozenset([""]), ALWAYS
    return None, ALWAYS  # classes, any character, references: nothing mandatory


def trigram_query(pattern: str) -> Query:
    """Sound for any expression the standard parser reads: a text with a match
    contains all trigrams of one of the sets. ALWAYS if nothing is mandatory."""
    return _fold(re._parser.parse(pattern))[1]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(tri, k1, k2): the documents whose folded text contains the trigram."""
    d = pinned(docs.select("doc_id", "text"), folded=ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    has = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("folded"), t))
    return d.select(*doc_key(), F.explode(has).alias("tri")).select("tri", "k1", "k2")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, rules): the indexed rules whose trigram query the document meets."""
    spark = docs.sparkSession
    clauses = [(r.kind, i, t, len(c)) for r in rules if (q := trigram_query(r.pattern)) != ALWAYS
               for i, c in enumerate(sorted(map(sorted, q))) for t in c]
    if not clauses:
        return spark.createDataFrame([], "k1 long, k2 long, rules array<string>")
    index = write_out(postings(docs, sorted({t for _, _, t, _ in clauses})).sortWithinPartitions("tri"), "postings")
    need = spark.createDataFrame(clauses, "kind string, clause int, tri string, n int")  # a few rows of each rule
    met = index.distinct().join(F.broadcast(need), "tri").groupBy("k1", "k2", "kind", "clause", "n").agg(F.count("*").alias("got"))
    return met.where(F.col("got") == F.col("n")).groupBy("k1", "k2").agg(F.collect_set("kind").alias("rules"))


def _spans(text: str, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end, kind): the pieces between matches and the
    matches themselves give the places, from left to right."""
    text, pattern = F.col(text), F.lit(rule.pattern)
    parts = F.zip_with(F.transform(F.split(text, rule.pattern, -1), F.char_length), F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part")),
        lambda gap, m: F.struct(gap.alias("gap"), m["hit"].alias("hit"), F.char_length(m["part"]).alias("chars")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc, m):
        start = acc["at"] + m["gap"]
        end = start + F.char_length(m["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(m["chars"] >= rule.min_chars, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.filter(parts, lambda m: m["hit"].isNotNull())
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of ``docs`` in a struct ``row`` and the array ``spans`` of
    (start, rank, end, kind), in order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(),
                       F.coalesce(F.col("text"), F.lit("")).alias("body"))
    d = rows.join(candidates(docs, rules), ["k1", "k2"], "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    per_rule = []
    for rank, r in enumerate(rules):
        spans = _spans("body", r, rank)
        everywhere = trigram_query(r.pattern) == ALWAYS
        per_rule.append(spans if everywhere else F.when(F.array_contains("rules", r.kind), spans).otherwise(empty))
    return pinned(d, spans=F.sort_array(F.concat(*per_rule))).select("row", "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql() -> str:
    found = "\nUNION ALL\n".join(f"""SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, hits, pieces, parts, {r.min_chars} AS least,
       unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(body, '{p}', 0) AS hits, regexp_extract_all(body, '{p}', {r.group}) AS parts,
         string_split_regex(body, '{p}') AS pieces FROM d)""" for rank, r in enumerate(RULES) for p in [r.pattern.replace("'", "''")])
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({found}),
placed AS (
  SELECT doc_id, kind, rank, length(hits[i]) AS n,
         list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM found WHERE length(parts[i]) >= least),
spans AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM placed GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans s ON d.doc_id = s.doc_id
"""


@query("op5_trigram_index", _sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in RULES if r.base]))
    return out.select("row.doc_id", *[count(r.kind) for r in RULES if r.base], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
