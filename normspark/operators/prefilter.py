"""The prefilter: which sentences are worth a classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import deontic
from normspark.functions.columns import computed, let, strip, word_count


def with_strength(rows: DataFrame) -> DataFrame:
    """deontic_strength and deontic_markers, by priority strong, consequence, weak."""
    found = computed(rows, _found=deontic.strength(F.col("text")))
    return found.select(
        *[F.col(c) for c in rows.columns],
        F.col("_found.kind").alias("deontic_strength"),
        F.col("_found.markers").alias("deontic_markers"),
    )


def decide(rows: DataFrame, config: Config) -> DataFrame:
    """The candidate decision for rows with text, section_context and section_weight."""
    text, weight = F.col("text"), F.col("section_weight")
    none = F.array().cast("array<string>")
    bare = computed(rows, text=strip(text))
    read = computed(
        bare, _length=let(word_count(text), deontic.length_reason), _act=deontic.speech_act(text)
    )
    marked = with_strength(read)
    strength = F.col("deontic_strength")
    too_long = F.col("_length").isNotNull()
    epistemic = F.lit(False)
    if config.may_senses:
        epistemic = (
            (strength == "weak")
            & F.lower(text).contains("may")
            & (deontic.may_sense(text) == "epistemic")
        )
    marked = computed(marked, _epistemic=~too_long & epistemic)
    off = F.col("_epistemic")
    reason = (
        F.when(too_long, F.col("_length"))
        .when((strength == "none") & (weight < v.HIGH_SECTION_WEIGHT), "No deontic markers found")
        .when(off, "Epistemic 'may' (possibility, not permission)")
        .when(
            (strength == "weak") & (weight < v.LOW_SECTION_WEIGHT),
            F.concat(
                F.lit("Weak deontic marker in non-rule section '"),
                F.col("section_context"),
                F.lit("'"),
            ),
        )
        .otherwise("")
    )
    boost = F.when(strength == "none", F.lit(v.BOOST_UNMARKED))
    for name, factor in v.BOOST.items():
        boost = boost.when(strength == name, F.lit(factor) * weight)
    plain = too_long | off
    return (
        computed(marked, rejection_reason=reason)
        .withColumn("is_candidate", F.col("rejection_reason") == "")
        .withColumns(
            {
                "confidence_boost": F.when(F.col("is_candidate"), boost).otherwise(F.lit(0.0)),
                "speech_act": F.when(off, v.SPEECH_ACT_DEFAULT).otherwise(F.col("_act")),
                "deontic_strength": F.when(plain, "none").otherwise(strength),
                "deontic_markers": F.when(plain, none).otherwise(F.col("deontic_markers")),
                "section_context": F.when(too_long, "").otherwise(F.col("section_context")),
                "section_weight": F.when(too_long, 1.0).otherwise(weight),
            }
        )
        .drop("_length", "_act", "_epistemic")
    )


def without_sections(sentence_table: DataFrame) -> DataFrame:
    """Sentences outside any known section, as a batch run sees them."""
    return sentence_table.withColumns({"section_context": F.lit(""), "section_weight": F.lit(1.0)})


def candidates(sentence_table: DataFrame, config: Config) -> DataFrame:
    """Sentences that pass, with their hints. A run without prefilter passes everything, unhinted."""
    if not config.use_prefilter:
        return sentence_table.withColumns(
            {
                "deontic_strength": F.lit("unknown"),
                "speech_act": F.lit("unknown"),
                "section_context": F.lit("unknown"),
                "section_weight": F.lit(1.0),
                "confidence_boost": F.lit(0.0),
            }
        )
    decided = decide(without_sections(sentence_table), config)
    return decided.filter("is_candidate").drop(
        "is_candidate", "rejection_reason", "deontic_markers"
    )


def statistics(decided: DataFrame) -> DataFrame:
    """Totals and counts by strength, act and reason in one pass: (stat, key, n)."""
    keyed = decided.select(
        "is_candidate",
        "deontic_strength",
        "speech_act",
        F.trim(F.substring_index("rejection_reason", "(", 1)).alias("reason"),
    )
    sets = keyed.groupingSets(
        [
            [],
            [keyed.deontic_strength],
            [keyed.speech_act],
            [keyed.reason],
        ],
        keyed.deontic_strength,
        keyed.speech_act,
        keyed.reason,
    ).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.count_if("is_candidate").alias("kept"),
    )
    rate = F.when(F.col("n") > 0, F.round((F.col("n") - F.col("kept")) / F.col("n") * 100, 1))
    rows = F.when(
        F.col("g") == 7,
        F.array(
            _stat("total_sentences", "", F.col("n")),
            _stat("candidates", "", F.col("kept")),
            _stat("rejected", "", F.col("n") - F.col("kept")),
            _stat("filter_rate", "", F.coalesce(rate, F.lit(0.0))),
        ),
    )
    for g, name in ((3, "deontic_strength"), (5, "speech_act"), (6, "reason")):
        rows = rows.when(F.col("g") == g, F.array(_stat(name, F.col(name), F.col("n"))))
    return (
        sets.select(F.explode(rows).alias("r"))
        .select("r.*")
        .filter(~((F.col("stat") == "reason") & (F.col("key") == "")))
    )


def _stat(name: str, key, n):
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(F.lit(name).alias("stat"), key.alias("key"), n.cast("double").alias("n"))
