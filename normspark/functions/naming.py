"""Names, slugs and keyword sets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions.columns import capitalized, let, literals


def camel(parts: Column) -> Column:
    """First word as it is, the others capitalized."""
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), capitalized)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def pascal(parts: Column) -> Column:
    return F.array_join(F.transform(parts, capitalized), "")


def slug(text: Column, max_words: int) -> Column:
    """camelCase of the first words, letters and digits only."""
    spaced = F.regexp_replace(text, r"(?U)\s+", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-zA-Z0-9 ]", ""), " +", " "))

    def joined(b: Column) -> Column:
        name = pascal(F.slice(F.split(b, " "), 1, max_words))
        return F.when(b == "", F.lit(v.EMPTY_SLUG)).otherwise(lower_first(name))

    return let(bare, joined)


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def formula_name(predicate: Column) -> Column:
    """A formula predicate in camelCase: cut before every capital, then joined."""
    spaced = F.trim(F.regexp_replace(predicate, "([A-Z])", " $1"))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), capitalized)
        return F.concat(lower_first(F.get(parts, F.lit(0))), F.array_join(rest, ""))

    return let(F.split(F.regexp_replace(spaced, " +", " "), " "), joined)


def long_words(text: Column, least: int = 3) -> Column:
    """Distinct runs of at least that many letters, lower case."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    )


def keywords(text: Column, config: Config) -> Column:
    """Words of a text that carry meaning."""
    return F.array_except(long_words(text), literals(config.stop_words))


def cut_domain_words(text: Column, config: Config) -> Column:
    """Domain words cut out of a run-together name, longest first, each once.

    What is left over counts from four letters on. Fewer than two words in all means no cut.
    """
    start = F.struct(F.lower(text).alias("left"), literals([]).cast("array<string>").alias("found"))

    def step(acc: Column, word: Column) -> Column:
        left = acc["left"]
        at = F.call_function("instr", left, word)
        rest = F.concat(
            F.substring(left, F.lit(1), at - 1),
            F.lit(" "),
            F.substring(left, at + F.length(word), F.length(left)),
        )
        return F.when(
            at > 0, F.struct(rest.alias("left"), F.array_append(acc["found"], word).alias("found"))
        ).otherwise(acc)

    def finish(acc: Column) -> Column:
        leftover = F.array_except(long_words(acc["left"], 4), literals(config.stop_words))
        return F.array_union(acc["found"], leftover)

    found = F.aggregate(literals(config.domain_words_longest_first), start, step, finish)
    return let(
        found,
        lambda f: F.when(F.size(f) >= 2, f).otherwise(literals([]).cast("array<string>")),
    )


def name_keywords(name: Column, config: Config) -> Column:
    """Keywords of a camelCase or snake_case name; one long run is cut at domain words."""
    spaced = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2")

    def chosen(parts: Column) -> Column:
        cut = F.when((F.size(parts) <= 1) & (F.length(name) > 10), cut_domain_words(name, config))
        return let(cut, lambda c: F.when(F.size(c) > 0, c).otherwise(parts))

    return F.array_except(let(long_words(spaced), chosen), literals(config.stop_words))


def subject_candidates(subject: Column) -> Column:
    """Class names a subject phrase may mean: all words joined, then each word."""
    found = F.regexp_extract_all(F.lower(subject), F.lit("[A-Za-z]+"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*v.DETERMINERS))
    single = F.transform(
        kept,
        lambda w: F.when(
            w.endswith("s") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)
        ).otherwise(w),
    )
    return let(
        F.transform(single, capitalized),
        lambda names: F.when(F.size(names) == 0, names).otherwise(
            F.concat(F.array(F.array_join(names, "")), names)
        ),
    )
