"""Pages to sentences, and sentences to numbered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import segment as seg
from normspark.operators.keyed import ordinal

POSITION = ("source", "page", "item_pos", "sent_pos")


def normalised_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", seg.normalise(F.col("raw_text")))


def items(pages: DataFrame) -> DataFrame:
    """One row per list item of a page."""
    return normalised_pages(pages).select(
        "source", "page", F.posexplode(seg.list_items(F.col("text"))).alias("item_pos", "item")
    )


def parts(pages: DataFrame) -> DataFrame:
    """One row per sentence part of an item, as split."""
    return items(pages).select(
        "source",
        "page",
        "item_pos",
        F.posexplode(seg.sentence_parts(F.col("item"))).alias("sent_pos", "part"),
    )


def fragments(pages: DataFrame) -> DataFrame:
    """Cleaned parts with at least five characters."""
    return pages.select("source", "page", F.inline(seg.page_fragments(F.col("raw_text"))))


def sentences(pages: DataFrame) -> DataFrame:
    """The sentence table: fragments that are not noise.

    A page is cut, cleaned and filtered inside its own row, so this needs no shuffle and also
    runs on a stream.
    """
    return pages.select("source", "page", F.inline(seg.page_sentences(F.col("raw_text"))))


def sentence_total(sentence_table: DataFrame) -> DataFrame:
    return sentence_table.agg(F.count("*").alias("total_sentences"))


def rule_id(number: Column, config: Config) -> Column:
    """Prefix and number, four digits at least."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return F.concat(F.lit(config.rule_prefix + "-"), padded)


def numbered(candidates: DataFrame, config: Config) -> DataFrame:
    """Candidates with their rule id: the ordinal in reading order."""
    return ordinal(candidates, POSITION).withColumn("rule_id", rule_id(F.col("ordinal"), config))
