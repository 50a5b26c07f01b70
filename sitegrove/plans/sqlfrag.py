"""DuckDB SQL fragments mirroring the column functions (for the oracles)."""

from __future__ import annotations

import re

from ..functions import text as TX
from ..functions.scalars import HOST_PATTERN, JS_WHITESPACE, PATH_PATTERN

NL = "chr(10)"
JS_WS = "(" + " || ".join(f"chr({ord(c)})" for c in JS_WHITESPACE) + ")"


def js_trim(e: str) -> str:
    return f"trim({e}, {JS_WS})"


def pattern(pat: str) -> str:
    """A pattern as an SQL string: the engines differ in how they spell a code
    point."""
    return "'" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pat).replace("'", "''") + "'"


def rx(e: str, pat: str, rep: str = "''", opts: str = "g") -> str:
    return f"regexp_replace({e}, {pattern(pat)}, {rep}, '{opts}')"


def clean_pre(e: str) -> str:
    """F1-F3."""
    for pat in (TX.COMMENT_RE, TX.SCRIPT_RE, TX.STYLE_RE):
        e = rx(e, pat)
    return e


def clean_post(e: str) -> str:
    """F5-F9."""
    s = rx(e, TX.CONSENT_RE)
    s = rx(s, TX.BLANK_RUN_RE, f"{NL}||{NL}||{NL}")
    for pat in (TX.LINKED_PIXEL_RE, TX.EMPTY_IMAGE_RE, TX.CTA_RE):
        s = rx(s, pat)
    for run, short in TX.MARKUP_RUNS:
        s = rx(s, run, f"'{short}'")
    return s


def clean_basic(e: str) -> str:
    """F1-F3, F5-F9 (no F4, no F10, no trim)."""
    return clean_post(clean_pre(e))


def boilerplate(e: str) -> str:
    """F4 without look-ahead: a mark is put before every line that begins with an
    h1-h3 heading, a section runs up to the next mark, the marks go again. The
    second pass marks headings whose line the first one had used up."""
    mark = "chr(1)"
    heading = rf"\n(#{{1,3}}{TX.JS_SPACE_CLASS})"
    s = rx(e, heading, rf"{mark} || {NL} || '\1'")
    s = rx(s, "([^\\x01])" + heading, rf"'\1' || {mark} || {NL} || '\2'")
    start = TX.BOILERPLATE_RE[:TX.BOILERPLATE_RE.index("[\\s\\S]")]
    return f"replace({rx(s, start + '[^\\x01]*')}, {mark}, '')"


def host(url: str) -> str:
    h = f"regexp_extract({url}, '{HOST_PATTERN}', 1)"
    return f"(CASE WHEN {h} <> '' THEN lower({h}) END)"


def path(url: str) -> str:
    return f"(CASE WHEN regexp_matches({url}, '{HOST_PATTERN}') THEN regexp_extract({url}, '{PATH_PATTERN}', 1) END)"


def category(url: str) -> str:
    p = path(url)
    return (f"(CASE WHEN {p} IS NULL THEN 'other' ELSE coalesce("
            f"list_filter(string_split({p}, '/'), lambda s: s <> '')[1], 'root') END)")


def title(e: str) -> str:
    lines = f"string_split({e}, {NL})"
    h1 = f"list_filter({lines}, lambda l: starts_with(l, '# '))[1]"
    anyh = f"list_filter({lines}, lambda l: regexp_matches(l, {pattern(TX.ANY_HEADING_RE)}))[1]"
    first = f"list_filter(list_transform({lines}, lambda l: {js_trim('l')}), lambda l: length(l) > 0)[1]"
    return (f"coalesce({js_trim(f'substr({h1}, 3)')}, "
            f"{js_trim(rx(anyh, TX.ANY_HEADING_RE, opts=''))}, substr({first}, 1, 100), 'Untitled Page')")


def last_segment(url: str) -> str:
    return f"string_split({url}, '/')[-1]"
