"""Formula responses to formulas: choice of attempt, repair from the formula or the rule text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import formula as fx
from normspark.functions.columns import computed, strip
from normspark.functions.jsontext import plain_text, with_object
from normspark.operators.classify import MODEL
from normspark.operators.keyed import lookup
from normspark.operators.responses import FORMULA_VERSION, request_key

FIELDS = (
    "deontic_type", "deontic_formula", "fol_expansion", "subject", "action", "condition",
    "shacl_hint", "has_object", "readable", "placeholder",
)


def formula_key() -> Column:
    return request_key(
        F.col("text"), MODEL, "fol_generation", FORMULA_VERSION, rule_type=F.col("rule_type")
    )


def vocabulary_text(vocabulary: DataFrame) -> DataFrame:
    """The whole vocabulary as one line for a request; it is a configuration list, not data."""
    return vocabulary.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "prop"))), lambda t: t["prop"]),
            ", ",
        ).alias("vocabulary")
    )


def requests(rules: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rules with cache key and formula request."""
    words = vocabulary_text(vocabulary).scalar()
    request = F.concat(
        F.lit("Write the rule as a deontic formula O, P or F(predicate(subject)).\nType: "),
        F.col("rule_type"),
        F.lit('\nRule: "'),
        F.col("text"),
        F.lit('"\nPrefer predicates from: '),
        words,
        F.lit(
            "\nAnswer with one JSON object: deontic_type, deontic_formula, fol_expansion,"
            " predicates, shacl_hint."
        ),
    )
    return rules.withColumns({"cache_key": formula_key(), "request": request})


def read_responses(store: DataFrame) -> DataFrame:
    """Formula fields of every response; parsed is false without formula and expansion."""
    found = with_object(store, "response_json", "_obj")
    doc = computed(found, _v=F.try_parse_json("_obj")).drop("_obj")

    def text(path: str) -> Column:
        return F.try_variant_get("_v", path, "string")

    preds = F.try_variant_get("_v", "$.predicates", "variant")
    opened = computed(
        doc,
        deontic_type=text("$.deontic_type"),
        deontic_formula=text("$.deontic_formula"),
        fol_expansion=text("$.fol_expansion"),
        shacl_hint=F.coalesce(text("$.shacl_hint"), F.lit("")),
        _kind=F.coalesce(F.schema_of_variant(preds), F.lit("VOID")),
        _scalar=F.coalesce(F.try_variant_get(preds, "$", "string"), F.lit("")),
        **{
            name: plain_text(F.try_variant_get("_v", f"$.predicates.{name}", "variant"))
            for name in ("subject", "action", "condition")
        },
    )
    is_object = F.col("_kind").startswith("OBJECT")
    return (
        opened.withColumns(
            {
                "has_object": is_object,
                "readable": is_object | (F.col("_kind") == "VOID") | (F.col("_scalar") == ""),
                "parsed": F.col("deontic_formula").isNotNull()
                & F.col("fol_expansion").isNotNull(),
            }
        )
        .withColumn("placeholder", placeholder())
        .drop("_v", "_kind", "_scalar")
    )


def placeholder() -> Column:
    return fx.is_placeholder(
        F.col("deontic_formula"), F.col("readable"), F.col("action"), F.col("subject")
    )


def chosen_attempt(read: DataFrame, retries: int) -> DataFrame:
    """One row per key: the earliest attempt without placeholder, else the latest one.

    Needs a readable first attempt. A handful of attempts per key, combined map-side.
    """
    bad = F.col("placeholder")
    order = F.struct(bad, F.when(bad, -F.col("attempt")).otherwise(F.col("attempt")))
    return (
        read.filter(F.col("parsed") & (F.col("attempt") <= retries))
        .groupBy("cache_key")
        .agg(
            F.min("attempt").alias("_first"),
            F.min_by(F.struct("attempt", *FIELDS), order).alias("_best"),
        )
        .filter(F.col("_first") == 0)
        .select("cache_key", "_best.*")
    )


def completed(rows: DataFrame, retries: int) -> DataFrame:
    """Formulas made usable: from the rule text while still a placeholder, else from themselves."""
    redo, last = F.col("_redo"), F.col("_last")
    kind, text = F.col("deontic_type"), F.col("deontic_formula")

    def stock(c: Column) -> Column:
        return F.lower(c).isin(*v.STOCK_NOUNS) | (F.length(c) <= 1)

    marked = rows.withColumns(
        {
            "deontic_type": F.coalesce("deontic_type", "rule_type"),
            "_redo": F.col("placeholder") & F.col("has_object"),
            "_last": ~F.col("placeholder") & (F.col("attempt") == retries),
        }
    )
    read = text_predicates(marked, F.col("_redo"))
    filled = computed(
        read,
        action=F.when(redo & stock(F.col("action")), F.col("_text_action"))
        .when(last, fx.backfilled(F.col("action"), text, "action"))
        .otherwise(F.col("action")),
        subject=F.when(redo & stock(F.col("subject")), F.col("_text_subject"))
        .when(last, fx.backfilled(F.col("subject"), text, "subject"))
        .otherwise(F.col("subject")),
        condition=F.when(redo & (F.col("condition") == ""), F.col("_text_condition")).otherwise(
            F.col("condition")
        ),
    )
    a, s, c = F.col("action"), F.col("subject"), F.col("condition")
    written = computed(
        filled,
        deontic_formula=F.when(redo, fx.composed_formula(kind, a, s)).otherwise(text),
        fol_expansion=F.when(redo, fx.composed_expansion(kind, a, s, c)).otherwise(
            F.col("fol_expansion")
        ),
        shacl_hint=F.when(redo, F.concat(a, F.lit(" property"))).otherwise(F.col("shacl_hint")),
        readable=F.col("readable") | last,
    )
    return written.withColumn("placeholder", placeholder()).drop(
        "_redo", "_last", "_text_subject", "_text_action", "_text_condition"
    )


def text_predicates(rows: DataFrame, needed: Column | None = None) -> DataFrame:
    """Subject, action and condition read from the rule text, where needed, else null."""
    low = strip(F.lower("text"))
    step = computed(rows, _low=low if needed is None else F.when(needed, low))
    step = computed(
        step,
        _text_subject=F.when(F.col("_low").isNotNull(), fx.text_subject(F.col("_low"))),
        _rest=fx.without_subject(F.col("_low")),
    )
    step = computed(
        step, _found=F.when(F.col("_rest").isNotNull(), fx.text_action(F.col("_rest")))
    )
    step = computed(step, _text_condition=fx.text_condition(F.col("_rest"), F.col("_found")))
    named = F.when(F.col("_found") == "", "action").otherwise(F.col("_found"))
    return step.withColumn("_text_action", named).drop("_low", "_rest", "_found")


def formalised(rules: DataFrame, store: DataFrame, config: Config) -> DataFrame:
    """Every rule with parse_success and, where that holds, its finished formula."""
    best = chosen_attempt(read_responses(store), config.formula_retries)
    keyed = rules.drop("cache_key").withColumn("cache_key", formula_key())
    joined = lookup(keyed, best, "cache_key")
    return completed(joined, config.formula_retries).withColumn(
        "parse_success", F.col("deontic_formula").isNotNull()
    )


def formulas(all_rules: DataFrame) -> DataFrame:
    return all_rules.filter("parse_success")


def failed(all_rules: DataFrame) -> DataFrame:
    return all_rules.filter("NOT parse_success")
