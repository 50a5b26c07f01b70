"""Cleaning quirks on literal rows (F1-F17) and main-content extraction
against a direct re-statement of the state machine."""

import random

from pyspark.sql import functions as F

from sitegrove.functions import scalars as S
from sitegrove.functions import text as T
from sitegrove.operators import text_ops as X


def _one(spark, col_fn, text):
    return spark.createDataFrame([(text,)], "t string").select(col_fn(F.col("t")).alias("o")).first().o


def test_comment_removal_means_no_change(spark):
    a = "# Title\n\nBody text"
    b = a + "\n<!-- build 42 -->"
    assert _one(spark, T.clean_markdown, a) == _one(spark, T.clean_markdown, b)


def test_script_style_blocks(spark):
    s = "x<SCRIPT type='a'>var t='</p>';</script>y<style>p{}</style>z"
    assert _one(spark, T.clean_markdown, s) == "xyz"


def test_boilerplate_section_to_next_heading(spark):
    s = "# Intro\ntext\n## Navigation\n- a\n- b\n## Body\nmore"
    assert _one(spark, T.clean_markdown, s) == "# Intro\ntext\n\n## Body\nmore"
    assert _one(spark, T.clean_markdown, "top\n### Footer links\nx\ny") == "top"


def test_consent_cta_lines_need_newline(spark):
    s = "We use cookies. Privacy notice here\nkeep\nSubscribe to our newsletter\nlast Sign up"
    assert _one(spark, T.clean_markdown, s) == "keep\nlast Sign up"


def test_markup_runs_and_images(spark):
    s = "a ***b*** ____ ######## h ![](x.png) [![](p.gif)](http://t)"
    assert _one(spark, T.clean_markdown, s) == "a **b** __ ###### h"


def test_heading_dedupe_keeps_first(spark):
    s = "# A\nx\n# a \ny\n## B\n#  a\n# A\nz"
    # key is lower-cased and trimmed; inner spaces still count
    assert _one(spark, T.dedupe_headings, s) == "# A\nx\ny\n## B\n#  a\nz"


def test_blank_runs(spark):
    assert _one(spark, T.collapse_blank_runs, "a\n\n\n\n\nb") == "a\n\n\nb"


def test_metadata_lines(spark):
    s = "Author: me\n5 min read\nBody\nShare on: x\nLast updated: now"
    assert _one(spark, T.drop_metadata_lines, s) == "\n\nBody\n\n"


def test_title_rules(spark):
    assert _one(spark, T.extract_title, "intro\n## Sub\n# Main ") == "Main"
    assert _one(spark, T.extract_title, "intro\n### Sub  ") == "Sub"
    assert _one(spark, T.extract_title, "\n  " + "x" * 150) == "x" * 100
    assert _one(spark, T.extract_title, " \n ") == "Untitled Page"


def test_enhancement_and_summary(spark):
    s = "line one\nCookie Policy\n\nNext Page >\nkept"
    assert _one(spark, T.enhance_content, s) == ("# [Processed Document]\n\nline one\nkept\n\n---\n"
                                                "_Content processed and optimized for LLM consumption_")
    assert _one(spark, T.deterministic_description, "\nrest") == "Page content"
    assert _one(spark, T.deterministic_summary, "x" * 501) == "x" * 500


def test_scalar_functions(spark):
    assert _one(spark, S.normalize_domain, "https://www.Example.com/docs/") == "Example.com"
    assert _one(spark, S.hostname, "  Example.COM/path ") == "example.com"
    assert _one(spark, S.sanitize_url, "https://a.b-c.com/x?y") == "a_b_c_com_x_y"
    assert _one(spark, S.human_minutes, 1501) == "1 day, 1 hour, 1 minute"
    assert _one(spark, S.human_minutes, 0) == "0 minutes"
    assert _one(spark, S.human_minutes, 2880) == "2 days"
    assert _one(spark, S.title_case_slug, "getting-started-API") == "Getting Started API"
    assert _one(spark, S.path_category, "https://x.com/") == "root"
    assert _one(spark, S.path_category, "not a url") == "other"
    assert _one(spark, S.path_category, "https://x.com//docs/a") == "docs"


def _direct_main(text):
    """The extraction rules restated line by line (independent of the helper)."""
    import re
    main_re = re.compile(r"^#{1,2}\s*(Introduction|Overview|Getting Started|About|Content|Main|Article)", re.I)
    skip_re = re.compile(r"^#{1,3}\s*(Navigation|Menu|Sidebar|Footer|Related|Share|Comments|Advertisement)", re.I)
    out, inside, depth = [], False, 0
    for line in text.split("\n"):
        if main_re.search(line):
            inside, depth = True, 0
        if skip_re.search(line):
            inside = False
            continue
        if inside or depth > 0:
            if len(line.strip()) > 50:
                depth += 1
            out.append(line)
        if not inside and len(line.strip()) > 100:
            depth += 1
            out.append(line)
    return out


def test_main_content_state_machine_random():
    rnd = random.Random(3)
    pool = ["# Overview", "## Sidebar", "### Footer", "short", "x" * 60, "y" * 120, "", "## Article body"]
    for _ in range(2000):
        text = "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert X.main_content_lines(text) == _direct_main(text)


def test_main_content_fallback(spark):
    df = spark.createDataFrame([(1, "short\n# Intro\ntext")], "id long, t string")
    r = X.extract_main_content(df, "t", "m").first()
    assert r.main_fallback and r.m == "short\n# Intro\ntext"


def test_literal_tests_change_nothing(spark):
    """Every cleaning step equals its plain pattern on texts made of their parts."""
    import random
    rnd = random.Random(21)
    bits = ["<!--", "-->", "<script", "<SCRIPT>", "</Script>", "<style>", "</style>", "#", "## ", "\n", "\n\n", "\r\n", " ", "\u0085", " ", " ",
            "Menu", "NAVIGATION", "footer", "header", "sidebar", "cookie ", "GDPR", "notice", "Notİce", "not", "ice", "privacy", "consent", "sign up", "Sign Up",
            "Subscribe", "sub", "scribe", "newsletter", "NEWSLETTER", "get started for free", "![](x)", "[![](a)](b)", "![", "](", "***", "____", "########", "x", "É", "K", "ſ"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, t string")

    def plain(c, *patterns):
        for p, by in patterns:
            c = F.regexp_replace(c, p, by)
        return c
    steps = [(T.strip_comments, [(T.COMMENT_RE, "")]), (T.strip_scripts, [(T.SCRIPT_RE, "")]), (T.strip_styles, [(T.STYLE_RE, "")]),
             (T.drop_boilerplate_sections, [(T.BOILERPLATE_RE, "")]), (T.drop_consent_lines, [(T.CONSENT_RE, "")]),
             (T.collapse_blank_runs, [(T.BLANK_RUN_RE, "\n\n\n")]), (T.drop_empty_images, [(T.LINKED_PIXEL_RE, ""), (T.EMPTY_IMAGE_RE, "")]),
             (T.drop_cta_lines, [(T.CTA_RE, "")]), (T.clamp_markup_runs, T.MARKUP_RUNS)]
    c = F.col("t")
    chained = c
    for _, patterns in steps:
        chained = plain(chained, *patterns)
    from sitegrove.functions.scalars import js_trim
    d = df.select("id", *[(~f(c).eqNullSafe(plain(c, *p))).cast("int").alias(f"s{i}") for i, (f, p) in enumerate(steps)],
                  (~T.clean_markdown(c, dedupe=False).eqNullSafe(js_trim(chained))).cast("int").alias("all"),
                  *[(f(c) != c).cast("int").alias(f"c{i}") for i, (f, _) in enumerate(steps)])
    total = d.agg(*[F.sum(x).alias(x) for x in d.columns[1:]]).first().asDict()
    assert all(total[f"s{i}"] == 0 for i in range(len(steps))) and total["all"] == 0
    assert all(total[f"c{i}"] > 5 for i in range(len(steps)))
