"""DataFrame-level text operators: main-content extraction (F12) and the
cleaning pipeline (F15).

F12 decides for every line how often it is kept (0, 1 or 2 times) from where the
last main or skip heading stands and from which long lines came before it since
then. Those are running maxima of line numbers, computed with numpy over all
lines of an Arrow batch at once: map-only, no shuffle of the text. Everything
around it is built-in Spark expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.scalars import JS_WHITESPACE

_MAIN, _SKIP = re.compile(TX.MAIN_HEADING_RE), re.compile(TX.SKIP_HEADING_RE)
MIN_MAIN_LINES = 10


def times_kept(lines: list[str], doc: np.ndarray, dedupe: bool = False) -> np.ndarray:
    """How often each line is kept. ``doc``: the number of each line's document,
    ascending."""
    if not lines:
        return np.zeros(0, np.int64)
    at = np.arange(len(lines))
    doc_start = np.searchsorted(doc, doc)
    main = np.fromiter((_MAIN.match(x) is not None for x in lines), bool, len(lines))
    skip = np.fromiter((_SKIP.match(x) is not None for x in lines), bool, len(lines))
    size = np.fromiter((len(x.strip(JS_WHITESPACE)) for x in lines), np.int64, len(lines))

    def last(flag: np.ndarray) -> np.ndarray:
        """The line number of the last flagged line up to each line, or -1."""
        return np.maximum.accumulate(np.where(flag, at, -1))

    last_main = last(main)
    inside = (last_main >= doc_start) & (last_main > last(skip))
    epoch = np.maximum(doc_start, last_main)  # a main heading resets the depth
    deepens = ~skip & (size > np.where(inside, 50, 100))
    before = np.concatenate([[-1], last(deepens)[:-1]])
    deep = before >= epoch
    times = (inside | deep).astype(np.int64) + (~inside & (size > 100))
    times[skip] = 0
    return np.minimum(times, 1) if dedupe else times


def main_content_lines(text: str, dedupe: bool = False) -> list[str]:
    lines = text.split("\n")
    times = times_kept(lines, np.zeros(len(lines), np.int64), dedupe)
    return [x for x, n in zip(lines, times) for _ in range(n)]


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType())])


# characters whose lines are held at once, whatever the number of rows in a batch
CHARS_AT_ONCE = 2_000_000


def _extract(texts: pd.Series, dedupe: bool) -> pd.DataFrame:
    have = texts.notna().to_numpy()
    per_doc = [t.split("\n") for t in texts[have]]
    flat = [x for lines in per_doc for x in lines]
    ends = np.cumsum([0, *map(len, per_doc)])
    times = times_kept(flat, np.repeat(np.arange(len(per_doc)), np.diff(ends)), dedupe)
    text, n = np.full(len(texts), None, object), np.zeros(len(texts), np.int64)
    for row, i, j in zip(np.flatnonzero(have), ends, ends[1:]):
        text[row] = "\n".join(x for x, k in zip(flat[i:j], times[i:j]) for _ in range(k))
        n[row] = times[i:j].sum()
    return pd.DataFrame({"text": text, "lines": pd.arrays.IntegerArray(n.astype("int32"), ~have)})


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Neighbouring rows of some ``most`` characters; a longer row is one alone."""
    cuts, held = [0], 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            cuts.append(row)
            held = 0
        held += size
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


def _extract_udf(dedupe: bool):
    @F.pandas_udf(_RESULT)
    def extract(texts: pd.Series) -> pd.DataFrame:
        parts = slices([len(t) if isinstance(t, str) else 0 for t in texts], CHARS_AT_ONCE)
        return pd.concat([_extract(texts.iloc[i:j], dedupe) for i, j in parts], ignore_index=True)
    return extract


def main_content(col: Column, dedupe: bool = False) -> Column:
    """Struct(text, lines) of the extraction, before the fallback."""
    return _extract_udf(dedupe)(col)


def extract_main_content(df: DataFrame, col: str, out: str, key: str | None = None,
                         dedupe: bool = False) -> DataFrame:
    """F12 over a DataFrame: adds ``out`` (extracted text, or the cleaned input
    when fewer than 10 lines were kept), ``main_lines`` and ``main_fallback``."""
    tmp = f"__{out}_mc"
    d = df.withColumn(tmp, main_content(F.col(col), dedupe))
    fallback = F.col(f"{tmp}.lines") < MIN_MAIN_LINES
    return (d.withColumn(out, F.when(fallback, TX.clean_markdown(F.col(col))).otherwise(F.col(f"{tmp}.text")))
             .withColumn("main_lines", F.col(f"{tmp}.lines"))
             .withColumn("main_fallback", fallback)
             .drop(tmp))


def clean_pipeline(df: DataFrame, col: str, out: str, extract_main: bool = False,
                   remove_metadata: bool = True, dedupe_main: bool = False) -> DataFrame:
    """clean (F11), optional main-content extraction (F12, default off),
    optional metadata-line removal (F13, default on). Page processing uses both."""
    d = df.withColumn(out, TX.clean_markdown(F.col(col)))
    if extract_main:
        d = extract_main_content(d, out, out, dedupe=dedupe_main).drop("main_lines", "main_fallback")
    if remove_metadata:
        d = d.withColumn(out, TX.drop_metadata_lines(F.col(out)))
    return d
