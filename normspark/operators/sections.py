"""Section headers and the section a sentence belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions import deontic
from normspark.functions.columns import let, strip
from normspark.operators.keyed import running_last

MARK = "\u0001"


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """All matches of a header pattern: (pos, rank, title), positions counted from 0."""
    # (?d): only a newline ends a line, and '.' stops only there
    p = "(?mdU)" + pattern
    # a mark that the page itself holds becomes another control character of the same length
    clean = F.replace(text, F.lit(MARK), F.lit("\u0002"))

    def step(acc: Column, piece: Column) -> Column:
        title = F.regexp_replace(strip(F.regexp_extract(piece, p, 1)), "[:.]+$", "")
        hit = F.struct(acc["at"].alias("pos"), F.lit(rank).alias("rank"), title.alias("title"))
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            F.array_append(acc["found"], hit).alias("found"),
        )

    def read(pieces: Column) -> Column:
        start = F.struct(
            F.length(F.get(pieces, F.lit(0))).alias("at"),
            F.array().cast("array<struct<pos:int,rank:int,title:string>>").alias("found"),
        )
        return F.aggregate(
            F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda acc: acc["found"]
        )

    return let(F.split(F.regexp_replace(clean, f"({p})", MARK + "$1"), MARK, -1), read)


def page_headers(text: Column) -> Column:
    """Headers of a page, ordered by position and, at one position, by pattern."""
    found = [_matches(text, p, i) for i, p in enumerate(v.HEADER_PATTERNS)]
    return F.array_sort(F.concat(*found))


def headers(pages: DataFrame) -> DataFrame:
    """One row per header of a page."""
    return pages.select(
        "source", "page", F.explode(page_headers(F.col("raw_text"))).alias("h")
    ).select("source", "page", F.col("h.pos").alias("pos"), "h.rank", "h.title")


def cursor_positions(text: Column, sentence_list: Column) -> Column:
    """Where each sentence stands in its page, searched from the end of the last hit.

    A sentence that is not found gets the cursor itself. Positions count from 0.
    """
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, sentence: Column) -> Column:
        at = F.call_function("locate", sentence, text, acc["cursor"] + 1)
        return F.struct(
            F.when(at > 0, at - 1 + F.length(sentence)).otherwise(acc["cursor"]).alias("cursor"),
            F.array_append(
                acc["found"], F.when(at > 0, at - 1).otherwise(acc["cursor"])
            ).alias("found"),
        )

    return F.aggregate(sentence_list, start, step, lambda acc: acc["found"])


def nearest_header(found: Column, pos: Column) -> Column:
    """Title of the last header before a position; '' without one."""
    before = F.filter(found, lambda h: h["pos"] < pos)
    return F.coalesce(F.get(before, F.size(before) - 1)["title"], F.lit(""))


def place_sentences(pages: DataFrame) -> DataFrame:
    """Sentences of pages with position and section, all inside the page row.

    pages carries a sentences array in reading order; the output has one row per sentence.
    """
    placed = pages.withColumn("_headers", page_headers(F.col("raw_text"))).withColumn(
        "_pos", cursor_positions(F.col("raw_text"), F.col("sentences"))
    )
    flat = placed.select(
        "source",
        "page",
        "_headers",
        F.posexplode(F.arrays_zip(F.col("sentences"), F.col("_pos"))).alias("ord", "s"),
    ).select(
        "source",
        "page",
        "ord",
        F.col("s.sentences").alias("text"),
        F.col("s._pos").alias("pos"),
        nearest_header(F.col("_headers"), F.col("s._pos")).alias("section_context"),
    )
    return with_weight(flat)


def assign_sections(sentence_rows: DataFrame, header_rows: DataFrame, keys, pos="pos"):
    """As-of join of two tables: the last header strictly before each sentence of the same key.

    Both tables become one ordered stream per key. A sentence sorts ahead of a header at its own
    position, which makes the comparison strict.
    """
    extra = [c for c in sentence_rows.columns if c not in (*keys, pos)]
    left = sentence_rows.select(
        *keys, pos, F.lit(0).alias("_kind"), F.struct(*extra).alias("_row"),
        F.lit(None).cast("string").alias("_title"),
    )
    right = header_rows.select(
        *keys, pos, F.lit(1).alias("_kind"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.col("title").alias("_title"),
    )
    both = running_last(left.unionByName(right), list(keys), pos, "_title", "_last", tie="_kind")
    return both.filter(F.col("_kind") == 0).select(
        *keys, pos, "_row.*", F.coalesce("_last", F.lit("")).alias("section_context")
    )


def with_weight(rows: DataFrame) -> DataFrame:
    return rows.withColumn("section_weight", deontic.section_weight(F.col("section_context")))


