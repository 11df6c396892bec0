"""Small column helpers shared by the text functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v

GAP = f"{v.WHITE_CLASS}+"
WHITE_NOT_BLANK = v.WHITE.replace(" ", "")
UNEVEN = f"{v.WHITE_CLASS}(?:{v.WHITE_CLASS}+|(?<=[{WHITE_NOT_BLANK}]))"
BLANK_CHARACTERS = v.WHITE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used afterwards.

    A plain projection is merged into the filters and projections that use it, which repeats its
    regular expressions there and inflates the generated code. A one-row inline() keeps the steps
    apart; it streams inside the same stage and costs no shuffle.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    if len(kept) == len(df.columns):
        return df.select("*", F.inline(F.array(row)))
    fresh = {name: f"_new_{name}" for name in columns}
    row = F.struct(*[c.alias(fresh[name]) for name, c in columns.items()])
    added = df.select("*", F.inline(F.array(row)))
    return added.select(
        *kept, *[F.col(fresh[name]).alias(name) for name in columns]
    )


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_pattern(patterns: Iterable[str], flags: str = "(?iU)") -> str:
    """One alternation out of several patterns; (?U) gives letters and blanks their Unicode sense.

    A word boundary all patterns start with is tested once, ahead of the alternatives, and only in
    front of a letter that one of them begins with; a first word they share stands ahead of them, too.
    """
    all_ = list(patterns)
    if all(re.match(r"\\b[a-z]", p) for p in all_):
        shared = re.match(r"\\b(?:[a-z]+\\s\+)?", all_[0])[0]
        head = shared if all(p.startswith(shared) for p in all_) else r"\b"
        first = "".join(sorted({p[2] for p in all_}))
        return f"{flags}(?=[{first}]){head}(?:" + "|".join(p[len(head) :] for p in all_) + ")"
    return flags + "|".join(all_)


def first_match(text: Column, table: Iterable[tuple[str, str]], default: Column | None = None):
    """Value of the first pattern of an ordered table found in the text."""
    chain = None
    for pattern, value in table:
        test = text.rlike("(?U)" + pattern)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain if default is None else chain.otherwise(default)


def first_contained(text: Column, table: Iterable[tuple[str, object]], default: Column | None = None):
    """Value of the first key of an ordered table that is part of the text."""
    chain = None
    for key, value in table:
        test = text.contains(key)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain if default is None else chain.otherwise(default)


def literals(values: Iterable) -> Column:
    return F.array(*[F.lit(x) for x in values])


def words(text: Column, most: int = -1) -> Column:
    """Blank-separated words; no words for a blank text. With `most`, the last of as many holds the rest."""
    trimmed = strip(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, GAP, most)
    )


def word_count(text: Column) -> Column:
    """Number of words of a text without blanks at its ends."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    # regexp_count() makes a list of its matches: only for texts whose gaps are not all single blanks
    gaps = F.when(text.rlike(UNEVEN), F.regexp_count(text, F.lit(GAP))).otherwise(blanks)
    return F.when(text == "", 0).otherwise(gaps + 1)


def strip(text: Column) -> Column:
    """Remove blanks of any kind, newlines included, at both ends."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def single_blanks(text: Column) -> Column:
    """Runs of blanks of any kind as one blank; a single blank is no match, as most are."""
    return F.regexp_replace(text, UNEVEN, " ")


def capitalized(word: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def local_name(iri: Column) -> Column:
    """Part after the last '#', or after the last '/' when there is no '#'."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(
        F.substring_index(iri, "/", -1)
    )
