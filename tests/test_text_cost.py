"""What text steps may cost, read from plans and expressions, with the same results as before."""

import re

from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import segment as seg
from normspark.functions.columns import any_pattern, word_count
from normspark.operators import prefilter
from normspark.operators import segment as sg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_white_class_is_white():
    """The class with the short way out holds the same characters."""
    assert v.WHITE_CLASS != f"[{v.WHITE}]"
    low, white = re.fullmatch(r"\[(.*)&&(\[.*\])\]", v.WHITE_CLASS, re.S).groups()
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    assert [c for c in every if re.match(white, c)] == [c for c in every if re.match(f"[{low}]", c) and re.match(white, c)]


def test_fragments_of_a_page_are_its_cleaned_parts(spark):
    """Blanks are collapsed once per item, with the same fragments as part by part."""
    texts = [
        "One  two.\n \x0b Three\xa0\u2003 four:\u3000Five; six;\tSeven 3.",
        "Ends here. 12.\n(a)  Next\u2028one! 4 goes\r\non. \u0663.\n- A b c d e\x85 7 .",
        " \n", "", "x. \n2. Y z\n* a?\u205fB \n\n c",
    ]
    pages = spark.createDataFrame([("s", i, x) for i, x in enumerate(texts)], "source STRING, page INT, raw_text STRING")
    by_part = sg.parts(pages).select(
        "page", "item_pos", "sent_pos", seg.clean_fragment(F.col("part")).alias("text")
    ).filter(F.length("text") >= v.MIN_FRAGMENT_CHARS)
    got = sorted(tuple(r) for r in sg.fragments(pages).drop("source").collect())
    assert got and got == sorted(tuple(r) for r in by_part.collect())


def test_words_are_counted_the_same_on_even_and_uneven_gaps(spark):
    texts = ["", "one", "one two  three", "a\xa0b c", "a b c d", "a \n b\u3000c"]
    df = spark.createDataFrame([(x,) for x in texts], "text STRING")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [0, 1, 3, 3, 4, 3]
    assert "rlike" in str(word_count(F.col("text"))).lower()


def test_a_decision_copies_its_rows_four_times_at_most(spark):
    rows = spark.createDataFrame([("Students must not pay.",)], "text STRING")
    decided = prefilter.decide(prefilter.without_sections(rows), Config())
    assert plan(decided).count("Generate inline") <= 5


def test_shared_words_of_patterns_stand_ahead_of_them(spark):
    pattern = any_pattern(v.MAY_EPISTEMIC)
    assert pattern.count("may") == 1 and any_pattern((v.MAY,)).startswith("(?iU)(?=[m])")
    texts = ["It MAY  be", "it may\u2003lead\tto x", "dismay be", "may bee", "ma\u017f", "I\u017f mandatory", "mU\u017ft"]
    df = spark.createDataFrame([(x,) for x in texts], "t STRING")
    for group in (v.MAY_EPISTEMIC, v.MAY_DEONTIC, v.MAY_DEONTIC_FINE, v.MAY_EPISTEMIC_FINE, v.STRONG_MARKERS):
        new, old = any_pattern(group), "(?iU)" + "|".join(group)
        assert all(r[0] == r[1] for r in df.select(
            F.regexp_extract_all("t", F.lit(new), F.lit(0)), F.regexp_extract_all("t", F.lit(old), F.lit(0))
        ).collect())
