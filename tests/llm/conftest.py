import pytest

# columns that the operators' own names clash with
EXTRA = "k1 long, k2 long, score double, row string, lines string, n_hit long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, rows that repeat, ties."""
    prose = " ".join(f"word{i % 97} and{i % 31}" for i in range(60))
    long = "\n".join(f"A long line number {i} of a very long text that goes on and on." for i in range(6000))
    rows = [(1, prose, "en", "a", 10), (2, prose, "en", "a", 10), (2, prose, "en", "a", 10), (3, "", "en", "b", 0), (4, None, None, None, None),
            (None, None, None, None, None), (None, "no id here at all", "en", "b", 3), (5, long, "en", "b", 9), (6, "\n\n", "de", "b", 2),
            (7, "  \t ", "de", "b", 2), (8, "one", "de", "b", 3), (9, "Ünïcödé ßtraße 𝄞 emoji 😀 text", "de", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    names = [c.split() for c in EXTRA.split(", ")]
    return df.select("*", *[F.lit("7").cast(t).alias(n) for n, t in names])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
