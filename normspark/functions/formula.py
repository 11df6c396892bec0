"""Formula checks and predicates taken from rule text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions.columns import capitalized, first_match, let, strip
from normspark.functions.naming import camel, pascal


def is_placeholder(formula: Column, readable: Column, action: Column, subject: Column):
    """Whether a formula says nothing about the rule: stock words instead of predicates.

    readable is false where the predicates are neither an object nor missing; then only the
    formula text counts.
    """
    stock = (
        F.lower(action).isin(*v.STOCK_WORDS)
        | F.lower(subject).isin(*v.STOCK_WORDS)
        | (F.length(action) <= 1)
    )
    return formula.rlike("(?iU)" + v.STOCK_FORMULA) | (readable & stock)


def backfilled(current: Column, formula: Column, position: str) -> Column:
    """A missing or stock action or subject, taken from the formula where that has a real one."""
    stock = v.STOCK_WORDS if position == "action" else v.STOCK_WORDS[:-2]
    pattern = {
        "action": r"[OPF]\(([a-zA-Z_](?U:\w)*)",
        "subject": r"[OPF]\((?U:\w)+\(([a-zA-Z_](?U:\w)*)",
    }[position]
    bare = F.trim(current)
    bad = (F.length(bare) <= 1) | F.lower(bare).isin(*stock)
    found = F.regexp_extract(formula, pattern, 1)
    good = (F.length(found) > 1) & ~F.lower(found).isin(*stock)
    return F.when(bad & good, found).otherwise(current)


SUBJECT_HEAD = "(?U)^(?:" + "|".join(p.removeprefix("^") for p, _ in v.SUBJECT_PATTERNS) + ")"


def text_subject(low: Column) -> Column:
    """Role named at the start of a lower-case rule sentence."""
    return first_match(low, v.SUBJECT_PATTERNS, F.lit("person"))


def without_subject(low: Column) -> Column:
    """Lower-case rule text after its leading subject."""
    return strip(F.regexp_replace(low, SUBJECT_HEAD, ""))


def letter_words(text: Column, least: int = 1) -> Column:
    """Runs of letters at a word start, in order."""
    size = "+" if least == 1 else f"{{{least},}}"
    return F.regexp_extract_all(text, F.lit(rf"(?U)\b[a-z]{size}"), F.lit(0))


def _first(options: Column) -> Column:
    return F.get(F.filter(options, lambda x: x.isNotNull()), F.lit(0))


def modal_action(rest: Column) -> Column:
    """camelCase of the phrase after a modal, or null."""
    phrases = F.array(
        *[
            F.regexp_extract(rest, rf"(?U)(?:{head})\s+(.+?){v.ACTION_END}", 1)
            for head in v.MODAL_HEADS
        ]
    )

    def named(phrase: Column) -> Column:
        tidy = strip(F.regexp_replace(phrase, r"(?U)\s+", " "))
        bare = F.regexp_replace(tidy, r"(?U)^(?:to\s+|the\s+|a\s+|an\s+)", "")
        return let(letter_words(bare), lambda w: F.when(F.size(w) > 0, camel(w)))

    return _first(F.transform(phrases, named))


def verb_action(rest: Column) -> Column:
    """A known verb and up to two words after it, read in a short window around it, or null."""
    finds = []
    for verbs in v.ACTION_VERBS:
        pattern = rf"(?U)\b({verbs})\b"
        finds.append(
            F.struct(
                F.regexp_extract(rest, pattern, 1).alias("verb"),
                F.regexp_instr(rest, F.lit(pattern)).alias("at"),
            )
        )

    def named(find: Column) -> Column:
        begin = F.greatest(find["at"] - 10, F.lit(1))
        window = F.substring(rest, begin, find["at"] + F.length(find["verb"]) + 20 - begin)

        def action(parts: Column) -> Column:
            where = F.array_position(parts, find["verb"]).cast("int")
            after = F.when(where > 0, where).otherwise(F.lit(1)) + 1
            words = F.concat(F.array(find["verb"]), F.slice(parts, after, F.lit(2)))
            return F.when((find["at"] > 0) & (F.size(parts) >= 2), pascal(words))

        return let(letter_words(window), action)

    return _first(F.transform(F.array(*finds), named))


def leading_action(rest: Column) -> Column:
    """The first three meaningful words, or null."""

    def named(long: Column) -> Column:
        kept = F.filter(long, lambda w: ~w.isin(*v.LEADING_STOP_WORDS))
        return F.when((F.size(long) >= 2) & (F.size(kept) > 0), pascal(F.slice(kept, 1, 3)))

    return let(letter_words(rest, 3), named)


def text_action(rest: Column) -> Column:
    """Action named by the rest of a rule sentence, by the best method that finds one, or ''."""
    return F.coalesce(modal_action(rest), verb_action(rest), leading_action(rest), F.lit(""))


def text_condition(rest: Column, action: Column) -> Column:
    """What is left of the rest of a rule sentence without the action, at most 50 characters."""
    bare = F.regexp_replace(rest, SUBJECT_HEAD, "")
    spaced = F.lower(F.regexp_replace(action, "([a-z])([A-Z])", "$1 $2"))
    bare = F.when(action == "", bare).otherwise(F.replace(bare, spaced, F.lit("")))
    bare = strip(F.regexp_replace(bare, r"(?U)\s+", " "))
    bare = F.regexp_replace(bare, "(?U)" + v.CONDITION_HEAD, "")
    bare = F.regexp_replace(bare, "(?U)" + v.CONDITION_TAIL, "")
    return let(
        bare,
        lambda b: strip(
            F.when(
                F.length(b) > v.CONDITION_CHARS,
                F.concat(F.substring(b, 1, v.CONDITION_CHARS), F.lit("...")),
            ).otherwise(b)
        ),
    )


def symbol(deontic_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in v.DEONTIC_SYMBOL.items() for x in kv])
    return F.coalesce(F.try_element_at(table, deontic_type), F.lit("O"))


def composed_formula(deontic_type: Column, action: Column, subject: Column) -> Column:
    return F.concat(symbol(deontic_type), F.lit("("), action, F.lit("("), subject, F.lit("))"))


def composed_expansion(
    deontic_type: Column, action: Column, subject: Column, condition: Column
) -> Column:
    return F.concat(
        F.lit("∀x ("), capitalized(subject), F.lit("(x) ∧ "), condition, F.lit("(x) → "),
        symbol(deontic_type), F.lit("("), action, F.lit("(x)))"),
    )
