"""Wording tests of the prefilter, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions.columns import any_pattern, first_contained, let, literals, words


def strong_markers(text: Column) -> Column:
    return _found(text, v.STRONG_MARKERS)


def consequence_markers(text: Column) -> Column:
    return _found(text, v.CONSEQUENCE_MARKERS)


def weak_markers(text: Column) -> Column:
    return _found(text, v.WEAK_MARKERS)


def _found(text: Column, patterns) -> Column:
    return F.regexp_extract_all(text, F.lit(any_pattern(patterns)), F.lit(0))


def strength(text: Column) -> Column:
    """(kind, markers) by priority strong, consequence, weak.

    A weaker class is only searched where the stronger ones found nothing.
    """

    def of(kind: str, found: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), found.alias("markers"))

    def first(kind: str, found: Column, rest) -> Column:
        return let(found, lambda m: F.when(F.size(m) > 0, of(kind, m)).otherwise(rest(m)))

    return first(
        "strong", strong_markers(text),
        lambda _: first(
            "consequence", consequence_markers(text),
            lambda _: first("weak", weak_markers(text), lambda m: of("none", m)),
        ),
    )


def may_sense(text: Column) -> Column:
    """deontic, epistemic or ambiguous; n/a without the word 'may'."""
    return (
        F.when(~text.rlike(any_pattern((v.MAY,))), "n/a")
        .when(text.rlike(any_pattern(v.MAY_DEONTIC)), "deontic")
        .when(text.rlike(any_pattern(v.MAY_EPISTEMIC)), "epistemic")
        .when(text.rlike(any_pattern(v.MAY_EPISTEMIC_FINE)), "epistemic")
        .when(text.rlike(any_pattern(v.MAY_DEONTIC_FINE)), "deontic")
        .otherwise("ambiguous")
    )


def speech_act(text: Column) -> Column:
    """Act of the first group with a marker anywhere in the text."""
    markers = [(m, act) for act, group in v.SPEECH_ACTS for m in group]
    return let(F.lower(text), lambda low: first_contained(low, markers, F.lit(v.SPEECH_ACT_DEFAULT)))


def has_subject(text: Column) -> Column:
    """At least three words and a subject word among the first five."""
    w = words(F.lower(text), 6)
    return (F.size(w) >= 3) & F.arrays_overlap(F.slice(w, 1, 5), literals(v.SUBJECT_WORDS))


def length_reason(n: Column) -> Column:
    """Why a sentence of n words is rejected for its length; null when it is not."""
    return F.when(
        n < v.CANDIDATE_MIN_WORDS,
        F.format_string(f"Too short (%d words < {v.CANDIDATE_MIN_WORDS})", n),
    ).when(
        n > v.CANDIDATE_MAX_WORDS,
        F.format_string(f"Too long (%d words > {v.CANDIDATE_MAX_WORDS}), needs splitting", n),
    )


def section_weight(title: Column) -> Column:
    """Weight of a section title: exact key, else first key it contains, else neutral."""
    name = F.lower(F.trim(title))
    table = F.create_map(*[F.lit(x) for pair in v.SECTION_WEIGHTS for x in pair])
    partial = first_contained(name, v.SECTION_WEIGHTS)
    return F.when(name == "", F.lit(1.0)).otherwise(
        F.coalesce(F.try_element_at(table, name), partial, F.lit(1.0))
    )
