"""Markdown cleaning as column expressions.

Every step is a built-in Spark expression (``regexp_replace``, ``split``,
higher-order array functions), so a whole corpus is cleaned in one map-only
stage with no shuffle and no Python in the loop. The one per-line state machine
(F12, main-content extraction) is an Arrow-batched pandas UDF: it is map-only
too and needs no shuffle of the text.

Regex notes (the source patterns are JavaScript; Spark runs java.util.regex):
``$`` without multiline means end of input in JavaScript, so it is written
``\\z``; multiline line patterns are anchored with ``(?m)^`` which gives the
same leftmost matches as the unanchored JavaScript form (which cannot cross a
line end) without its quadratic scan on long lines. JavaScript's ``\\s`` and
``.`` are spelled as classes: Java's own are ASCII only, or stop at U+0085.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c, js_trim

# JavaScript's \s and . as classes (Java's \s is ASCII only).
JS_SPACE_CLASS = r"[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
JS_ANY_CLASS = r"[^\n\r\u2028\u2029]"
_S, _D = JS_SPACE_CLASS, JS_ANY_CLASS

# Cleaning patterns (behaviour of the reference's cleaner).
COMMENT_RE = r"<!--[\s\S]*?-->"
SCRIPT_RE = r"(?is)<script\b.*?</script>"
STYLE_RE = r"(?is)<style\b.*?</style>"
BOILERPLATE_RE = rf"(?i)#{{1,3}}{_S}*(Navigation|Menu|Sidebar|Footer|Header)[\s\S]*?(?=\n#{{1,3}}{_S}|\z)"
CONSENT_RE = rf"(?im)^{_D}*?(cookie|privacy|gdpr|consent){_D}*?notice{_D}*?\n"
BLANK_RUN_RE = r"\n{4,}"
LINKED_PIXEL_RE = r"\[!\[\]\([^\)]*\)\]\([^\)]*\)"
EMPTY_IMAGE_RE = r"!\[\]\([^\)]*\)"
CTA_RE = rf"(?im)^{_D}*?(Sign up|Subscribe|Newsletter|Get started for free){_D}*?\n"
METADATA_RES = [
    rf"(?im)^(Author|By|Written by|Published|Updated|Modified|Tags|Categories|Filed under):{_D}*$",
    rf"(?im)^(Last (updated|modified|changed)|Updated on|Modified on):{_D}*$",
    r"(?im)^\d+ (min|minute|minutes) read$",
    rf"(?im)^Reading time:{_D}*$",
    rf"(?im)^Share (on|this):{_D}*$",
]
MARKUP_RUNS = [(r"\*{3,}", "**"), (r"_{3,}", "__"), (r"#{7,}", "######")]
ANY_HEADING_RE = rf"^#{{1,6}}{_S}+"
MAIN_HEADING_RE = rf"(?i)^#{{1,2}}{_S}*(Introduction|Overview|Getting Started|About|Content|Main|Article)"
SKIP_HEADING_RE = rf"(?i)^#{{1,3}}{_S}*(Navigation|Menu|Sidebar|Footer|Related|Share|Comments|Advertisement)"
ENHANCE_DROP_PHRASES = ["Cookie Policy", "Terms of Service", "Previous Page", "Next Page"]
ENHANCE_HEADER = "# [Processed Document]\n\n"
ENHANCE_FOOTER = "\n\n---\n_Content processed and optimized for LLM consumption_"
UNTITLED = "Untitled Page"


# A pattern is run only on texts that hold a literal it needs; the literal test is
# a byte search. Texts are lower-cased for it: a superset of the pattern's case rule.
CONSENT_NEEDS = ["notice"]
CTA_NEEDS = ["sign up", "subscribe", "newsletter", "get started for free"]
BOILERPLATE_NEEDS = ["navigation", "menu", "sidebar", "footer", "header"]


def _bound(value: Column, fn) -> Column:
    """``fn`` of the value, which is evaluated once however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _holds(text: Column, literals: list[str]) -> Column:
    found = text.contains(literals[0])
    for w in literals[1:]:
        found = found | text.contains(w)
    return found


def _replaced(md, literals: list[str], pattern: str, by: str = "", lower: bool = False, all_of: str | None = None) -> Column:
    """``md`` with the pattern replaced, where it holds one of ``literals`` (and ``all_of``)."""
    def step(t: Column) -> Column:
        need = _holds(F.lower(t) if lower and len(literals) == 1 else t, literals) if not lower or len(literals) == 1 \
            else _bound(F.lower(t), lambda low: _holds(low, literals))
        if all_of:
            need = t.contains(all_of) & need
        return F.when(need, F.regexp_replace(t, pattern, by)).otherwise(t)
    return _bound(_c(md), step)


def strip_comments(md) -> Column:          # F1
    return _replaced(md, ["<!--"], COMMENT_RE)


def strip_scripts(md) -> Column:           # F2
    return _replaced(md, ["<script"], SCRIPT_RE, lower=True, all_of="<")


def strip_styles(md) -> Column:            # F3
    return _replaced(md, ["<style"], STYLE_RE, lower=True, all_of="<")


def drop_boilerplate_sections(md) -> Column:   # F4
    return _replaced(md, BOILERPLATE_NEEDS, BOILERPLATE_RE, lower=True, all_of="#")


def drop_consent_lines(md) -> Column:      # F5
    return _replaced(md, CONSENT_NEEDS, CONSENT_RE, lower=True)


def collapse_blank_runs(md) -> Column:     # F6
    return _replaced(md, ["\n\n\n\n"], BLANK_RUN_RE, "\n\n\n")


def drop_empty_images(md) -> Column:       # F7
    return _replaced(_replaced(md, ["[![]("], LINKED_PIXEL_RE), ["![]("], EMPTY_IMAGE_RE)


def drop_cta_lines(md) -> Column:          # F8
    return _replaced(md, CTA_NEEDS, CTA_RE, lower=True)


def clamp_markup_runs(md) -> Column:       # F9
    s = _c(md)
    for run, short in MARKUP_RUNS:
        s = _replaced(s, [short + short[0]], run, short)
    return s


def dedupe_headings(md) -> Column:         # F10
    """Keep the first line of each heading key (lower-cased, trimmed text of a
    line starting with '#'); every other line is kept.

    Runs in O(n log n) per document with two array sorts and no shuffle:
    lines are tagged (key, position), sorted so equal keys are adjacent, a
    line is a repeat when its sorted predecessor has the same key, then the
    survivors are put back in position order.
    """
    lines = F.split(_c(md), "\n", -1)
    tagged = F.transform(lines, lambda l, i: F.struct(
        F.when(l.startswith("#"), F.lower(js_trim(l))).alias("k"), i.alias("p"), l.alias("l")))
    by_key = F.array_sort(tagged)

    def flag(s):
        return F.transform(s, lambda e, i: F.struct(
            e["p"].alias("p"),
            (e["k"].isNull() | (i == 0) |
             ~F.when(i > 0, s[i - 1]["k"]).eqNullSafe(e["k"])).alias("keep"),
            e["l"].alias("l")))

    # bind the sorted array once (a one-element transform) so it is not re-sorted per element
    flagged = F.element_at(F.transform(F.array(by_key), flag), 1)
    kept = F.array_sort(F.filter(flagged, lambda e: e["keep"]))
    return F.array_join(F.transform(kept, lambda e: e["l"]), "\n")


def clean_markdown(md, dedupe: bool = True) -> Column:   # F11
    s = _c(md)
    for step in (strip_comments, strip_scripts, strip_styles, drop_boilerplate_sections,
                 drop_consent_lines, collapse_blank_runs, drop_empty_images, drop_cta_lines,
                 clamp_markup_runs):
        s = step(s)
    if dedupe:
        s = dedupe_headings(s)
    return js_trim(s)


def drop_metadata_lines(md) -> Column:     # F13
    s = _c(md)
    for pat in METADATA_RES:
        s = F.regexp_replace(s, pat, "")
    return s


def extract_title(md) -> Column:           # F14
    lines = F.split(_c(md), "\n", -1)
    h1 = F.try_element_at(F.filter(lines, lambda l: l.startswith("# ")), F.lit(1))
    any_h = F.try_element_at(F.filter(lines, lambda l: l.rlike(ANY_HEADING_RE)), F.lit(1))
    first = F.try_element_at(F.filter(F.transform(lines, js_trim), lambda l: F.length(l) > 0), F.lit(1))
    return F.coalesce(
        js_trim(F.substring(h1, 3, 1 << 30)),
        js_trim(F.regexp_replace(any_h, ANY_HEADING_RE, "")),
        F.substring(first, 1, 100),
        F.lit(UNTITLED),
    )


def enhance_content(md) -> Column:         # F16
    """Deterministic enhancement: drop lines holding one of four boilerplate
    phrases and blank lines, wrap in the fixed header and footer."""
    lines = F.split(_c(md), "\n", -1)

    def keep(l):
        cond = F.length(js_trim(l)) > 0
        for ph in ENHANCE_DROP_PHRASES:
            cond = cond & ~l.contains(ph)
        return cond

    body = F.array_join(F.filter(lines, keep), "\n")
    return F.concat(F.lit(ENHANCE_HEADER), body, F.lit(ENHANCE_FOOTER))


def deterministic_description(md) -> Column:   # F17 description
    first = F.split(_c(md), "\n", -1).getItem(0)
    return F.substring(F.when(first != "", first).otherwise(F.lit("Page content")), 1, 100)


def deterministic_summary(md) -> Column:       # F17 summary
    s = _c(md)
    return F.when(F.length(s) > 500, F.substring(s, 1, 500)).otherwise(F.lit(""))


def diff_normalize(md) -> Column:          # G1
    s = F.regexp_replace(_c(md), "\r\n", "\n")
    s = F.regexp_replace(s, "\t", "  ")
    return js_trim(s)


def fingerprint_normalize(md) -> Column:
    """G9 normalisation: lower case, every white-space run (new lines included)
    to one space, trimmed. (Per-line trim and new-line clamping of the source
    are no-ops once all new lines became spaces.)"""
    s = F.regexp_replace(F.lower(_c(md)), JS_SPACE_CLASS + "+", " ")
    return js_trim(s)


def fingerprint(md) -> Column:             # G9
    return F.sha2(fingerprint_normalize(md), 256)
