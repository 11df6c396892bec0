"""Text steps: the same cuts as the plain patterns, and each page cut once per header pattern."""

from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions import deontic
from normspark.functions import segment as seg
from normspark.functions.columns import strip, words
from normspark.operators import sections

BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])|(?<=:)\s+(?=[A-Z])|(?<=;)\s+(?=[A-Z])"
WRAP = r"(?<=[a-z,;:])\n(?=[a-z])"


def test_pages_are_cut_once_per_header_pattern(spark):
    df = spark.createDataFrame([("1. One\n\ntext\nGENERAL RULES\n\x01",)], "t STRING").select(
        sections.page_headers(F.col("t")).alias("h")
    )
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == len(v.HEADER_PATTERNS)
    assert [h["title"] for h in df.first()["h"]] == ["One", "GENERAL RULES"]


def test_text_steps_equal_the_plain_patterns(spark):
    odd = [
        None, "", " ", "a. B", "a.   Bc: D;　E: f", "x\ny,\n\nz\n \nq \t r\t\ts", "  End. 3.", "12.",
        "\x85a b ", "A.\x0b1", "a;  B:C ! D?\x1cE", "one two three four five six it", "it is", "it is so",
        "a 3.\n", "٣. b ٣.", "​x​", "no:\r\nYes;\n\nNo",
    ]
    df = spark.createDataFrame([(x,) for x in odd], "t STRING")
    t = F.col("t")
    plain = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, WRAP, " "), r"\n{2,}", "\n"), r"[ \t]+", " ")
    clean = F.regexp_replace(F.regexp_replace(plain, "(?U)" + v.TRAILING_NUMBER, ""), r"(?U)\s+", " ")
    listed = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"(?U)\s+"))
    listed = F.when(t.isNotNull(), listed)
    low = F.split(F.lower(plain), r"(?U)\s+")
    subject = (F.size(low) >= 3) & F.arrays_overlap(F.slice(low, 1, 5), F.array(*map(F.lit, v.SUBJECT_WORDS)))
    for new, old in (
        (strip(t), plain), (seg.normalise(t), wide), (seg.sentence_parts(t), F.split(t, BREAK, -1)),
        (seg.clean_fragment(t), clean), (F.when(t.isNotNull(), words(t)), listed), (deontic.has_subject(t), subject),
    ):
        assert [r[0] for r in df.select(new).collect()] == [r[0] for r in df.select(old).collect()], str(new)
