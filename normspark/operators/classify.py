"""Both sides of the classification: request rows out, response rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions.columns import computed
from normspark.functions.jsontext import greedy_object, missing_reason, truthy, with_object
from normspark.operators.keyed import lookup
from normspark.operators.responses import (
    CLASSIFY_VERSION,
    RECLASSIFY_VERSION,
    request_key,
)

MODEL = "default"
SECOND_MODEL = "second"
RESPONSE = "is_rule STRING, rule_type STRING, confidence STRING, reasoning STRING"


def with_hints(candidates: DataFrame, config: Config) -> DataFrame:
    """Hints as a run may use them; a run without hints also loses the boost."""
    if config.use_hints:
        return candidates
    return candidates.withColumns(
        {
            "deontic_strength": F.lit("unknown"),
            "speech_act": F.lit("unknown"),
            "section_context": F.lit("unknown"),
            "confidence_boost": F.lit(0.0),
        }
    )


def request_text() -> Column:
    """The request sent for a sentence: task, hints, sentence, answer format."""
    return F.concat(
        F.lit("Decide whether the sentence states a binding rule.\nStrength: "),
        F.col("deontic_strength"),
        F.lit("\nSpeech act: "),
        F.col("speech_act"),
        F.lit("\nSection: "),
        F.col("section_context"),
        F.lit('\nSentence: "'),
        F.col("text"),
        F.lit('"\nAnswer with one JSON object: is_rule, rule_type, confidence, reasoning.'),
    )


def requests(candidates: DataFrame, config: Config) -> DataFrame:
    """Candidates with cache key and request text. The key leaves the section out."""
    hinted = with_hints(candidates, config)
    key = request_key(
        F.col("text"),
        MODEL,
        "classification",
        CLASSIFY_VERSION,
        deontic_strength=F.col("deontic_strength"),
        speech_act=F.col("speech_act"),
    )
    return computed(hinted, cache_key=key).withColumn("request", request_text())


def parsed(rows: DataFrame) -> DataFrame:
    """Response text to fields; an unreadable one is 'not a rule' with the reason."""
    found = with_object(rows, "response_json", "_obj")
    fields = computed(found, _r=F.from_json("_obj", RESPONSE))
    return fields.withColumns(
        {
            "is_rule": truthy(F.col("_r.is_rule")),
            "raw_type": F.coalesce(
                F.col("_r.rule_type"), F.when(F.col("_obj").isNull(), "none").otherwise("")
            ),
            "raw_confidence": F.coalesce(
                F.expr("try_cast(_r.confidence AS DOUBLE)"),
                F.when(F.col("_obj").isNull(), F.lit(0.0)).otherwise(v.CONFIDENCE_DEFAULT),
            ),
            "reasoning": F.coalesce(
                missing_reason(F.col("response_json"), F.col("_obj")),
                F.col("_r.reasoning"),
                F.lit(""),
            ),
        }
    ).drop("_obj", "_r")


def sentence_check(raw: Column) -> Column:
    """Fields of a single-sentence answer, read from the first '{' to the last '}'."""
    return F.from_json(greedy_object(raw), RESPONSE)


def repaired(rows: DataFrame) -> DataFrame:
    """A rule with an unknown type becomes an obligation with less confidence."""
    known = F.col("raw_type").isin(*v.RULE_TYPES)
    lowered = F.greatest(F.col("raw_confidence") - v.REPAIR_PENALTY, F.lit(v.REPAIR_FLOOR))
    return rows.withColumns(
        {
            "rule_type": F.when(known, F.col("raw_type")).otherwise("obligation"),
            "base_confidence": F.when(known, F.col("raw_confidence")).otherwise(lowered),
        }
    )


def boosted(rows: DataFrame) -> DataFrame:
    """Confidence plus prefilter boost, kept within 0 and 1."""
    total = F.col("base_confidence") + F.coalesce("confidence_boost", F.lit(0.0))
    return rows.withColumn(
        "confidence", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    )


def banded(rows: DataFrame) -> DataFrame:
    """rule, uncertain or dropped."""
    return rows.withColumn(
        "band",
        F.when(~F.col("is_rule"), "dropped")
        .when(F.col("confidence") >= v.CONFIDENCE_RULE, "rule")
        .when(F.col("confidence") >= v.CONFIDENCE_UNCERTAIN, "uncertain")
        .otherwise("dropped"),
    )


def classified(request_rows: DataFrame, store: DataFrame) -> DataFrame:
    """Request rows with their response read, repaired, boosted and banded.

    Requests without a response yet are not in the result; they are the pending ones.
    """
    known = lookup(request_rows, store.select("cache_key", "response_json"), "cache_key", "inner")
    return banded(boosted(repaired(parsed(known))))


def second_key() -> Column:
    return request_key(F.col("text"), SECOND_MODEL, "reclassification", RECLASSIFY_VERSION)


def second_opinion(rows: DataFrame, store: DataFrame, config: Config) -> DataFrame:
    """All final rules: the sure ones, and uncertain ones a second response confirms."""
    rules = rows.filter(F.col("band") == "rule")
    if not config.use_second_opinion:
        return rules
    unsure = rows.filter(F.col("band") == "uncertain").withColumnsRenamed(
        {"rule_type": "_type", "confidence": "_confidence"}
    )
    asked = unsure.withColumn("cache_key", second_key()).drop(
        "response_json", "is_rule", "raw_type", "raw_confidence", "reasoning", "base_confidence"
    )
    second = parsed(
        lookup(asked, store.select("cache_key", "response_json"), "cache_key", "inner")
    )
    confirmed = second.filter(F.col("is_rule") & (F.col("raw_confidence") > v.SECOND_OPINION_ABOVE))
    given = F.when(F.col("raw_type") == "", F.col("_type")).otherwise(F.col("raw_type"))
    if config.repair_second_opinion:
        given = F.when(given.isin(*v.RULE_TYPES), given).otherwise("obligation")
    merged = confirmed.withColumns(
        {
            "rule_type": given,
            "confidence": F.col("raw_confidence"),
            "base_confidence": F.col("raw_confidence"),
        }
    ).drop("_type", "_confidence")
    return rules.unionByName(merged.select(*rules.columns))


def rule_list(rules: DataFrame, rule_type: str = "all", limit: int = v.RULE_LIST_LIMIT):
    """The first rules of a type in id order, with the number of all that match."""
    chosen = rules if rule_type == "all" else rules.filter(F.col("rule_type") == rule_type)
    total = chosen.agg(F.count("*").alias("n")).scalar()
    return chosen.orderBy("ordinal").limit(limit).withColumn("total_matching", total)
