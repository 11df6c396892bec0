"""Page text to sentence fragments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions.columns import let, single_blanks, strip


def normalise(raw: Column) -> Column:
    """Join soft-wrapped lines, then collapse blank lines and runs of blanks."""
    joined = F.regexp_replace(raw, v.SOFT_WRAP, " ")
    return F.regexp_replace(F.regexp_replace(joined, v.BLANK_LINES, "\n"), v.BLANKS, " ")


def list_items(text: Column) -> Column:
    """Pieces between list markers at line starts."""
    return F.transform(F.split(text, "(?U)" + v.LIST_MARKER, -1), strip)


def sentence_parts(item: Column) -> Column:
    """Pieces of one list item at sentence boundaries."""
    return F.split(item, v.SENTENCE_BREAK, -1)


def clean_fragment(part: Column) -> Column:
    """Trim, drop a list number left at the end, collapse blanks."""
    return single_blanks(let(strip(part), without_number))


def without_number(text: Column) -> Column:
    """Drop a list number left at the end; most texts end with a letter before their last mark."""
    before = F.substring(text, -2, 1)
    letter = ((before >= "a") & (before <= "z")) | ((before >= "A") & (before <= "Z"))
    ends = ~letter & F.substring(text, -2, 2).rlike(r"(?U)^\d\.$")
    return F.when(ends, F.regexp_replace(text, "(?U)" + v.TRAILING_NUMBER, "")).otherwise(text)


def is_noise(text: Column) -> Column:
    """Too few or too many words, page furniture, or a short line in capitals.

    The text is clean: single blanks between words, none at the ends.
    """
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    # a text that starts with another plain letter is no page furniture
    starts = ~F.substring(text, 1, 1).isin(*v.NOISE_NO_START)

    def noise(n: Column) -> Column:
        capitals = (n < v.NOISE_CAPS_WORDS) & (F.upper(text) == text) & text.rlike(r"\p{Lu}")
        return (
            (n < v.NOISE_MIN_WORDS)
            | (n > v.NOISE_MAX_WORDS)
            | (starts & text.rlike("(?iU)" + v.NOISE_START))
            | capitals
        )

    return let(blanks + 1, noise)


def page_fragments(raw: Column) -> Column:
    """All cleaned fragments of a page, (item_pos, sent_pos, text) in reading order.

    Blanks are collapsed once per item: runs of them decide no boundary by their length. A boundary
    takes all blanks around it and items are trimmed, so parts have none at their ends.
    """

    def of_item(item: Column, i: Column) -> Column:
        return F.transform(
            sentence_parts(single_blanks(item)),
            lambda part, j: F.struct(
                i.alias("item_pos"), j.alias("sent_pos"), without_number(part).alias("text")
            ),
        )

    found = F.flatten(F.transform(list_items(normalise(raw)), of_item))
    return F.filter(found, lambda f: F.length(f["text"]) >= v.MIN_FRAGMENT_CHARS)


def page_sentences(raw: Column) -> Column:
    """Fragments of a page that are not noise."""
    return F.filter(page_fragments(raw), lambda f: ~is_noise(f["text"]))
