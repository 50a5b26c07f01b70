"""The pipeline's stages on planted cases, and the registered queries."""

import random

import __spark_entry__ as entry
import corpus_pipeline as P
from sitegrove.llm.common import table, write_out

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    sql = entry.oracle_sql()
    assert {k for k in sql if k.startswith("op")} == {"op4_line_runs", "op5_trigram_index", "op8_pivot_table", "op9_prefix_join", "op11_fm_index", "op13_ida_star"}


def test_stages_take_effect(spark):
    rnd = random.Random(9)

    def prose(n):
        return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    line = "This very line of over forty characters stands in many documents."
    item = table(spark, SF, "benchmark").first().text
    base = prose(200)
    docs = [(i, prose(120) + "\n" + line, "en", "s", None) for i in range(6)]
    docs += [(10, base, "en", "s", 5), (11, base.replace(base.split()[100], "other"), "en", "s", 5), (12, base, "en", "s", 5)]
    docs += [(20, prose(30) + " " + item + " " + prose(30), "en", "s", 7), (21, prose(150), None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lines = {r.doc_id: r for r in P.lines(spark, df, SF).collect()}
    assert [line in lines[i].text for i in range(6)] == [False] * 5 + [True] and lines[0].n_chars == len(lines[0].text) and lines[5].n_chars is None
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, SF).collect()) == [0, 1, 2, 3, 4, 5, 10, 20, 21]
    clean = P.decontamination(spark, df, SF)
    assert clean.schema == df.schema and sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 3, 4, 5, 10, 11, 12, 21]


def test_run_is_the_chain_of_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        out = write_out(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    a = P.pack(spark, docs, SF).select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()
    b = P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()
    assert a == b and len(a) > 50


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        P.pack(spark, docs, SF).collect()
