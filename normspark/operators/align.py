"""Rule subjects to classes and rule actions to vocabulary properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import naming
from normspark.functions.columns import computed, first_match
from normspark.functions.similarity import alike
from normspark.operators.keyed import broadcast_checked, lookup, spread_join, stored

# --- classes --------------------------------------------------------------------------------


def ontology_classes(triples: DataFrame, config: Config) -> DataFrame:
    """Class names: subjects of subClassOf and every subject in the corpus namespace."""
    subject = F.col("s")
    return (
        triples.filter(
            (F.col("p") == v.RDFS_SUBCLASS) | subject.startswith(config.namespace)
        )
        .select(F.substring_index(subject, "#", -1).alias("class"))
        .distinct()
    )


def subject_class(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """rule_id and ontology_class: the first candidate of the subject that is a class."""
    candidates = rules.select(
        "rule_id",
        F.posexplode(naming.subject_candidates(F.coalesce("subject", F.lit("")))).alias(
            "pos", "class"
        ),
    )
    return (
        candidates.join(broadcast_checked(classes), "class")
        .groupBy("rule_id")
        .agg(F.min_by("class", "pos").alias("ontology_class"))
    )


def topic_class(low: Column) -> Column:
    return first_match(low, v.TOPIC_CLASSES)


def word_class(low: Column) -> Column:
    return first_match(low, v.WORD_CLASSES)


def corpus_class(low: Column, config: Config) -> Column:
    return first_match(
        low, [("(?i)" + p, c) for p, c in config.corpus_classes], F.lit(v.DEFAULT_CLASS)
    )


def text_class(low: Column, config: Config) -> Column:
    """Class of a lower-case text by topic, then by word, then by corpus pattern, then Person."""
    return F.coalesce(topic_class(low), word_class(low), corpus_class(low, config))


def with_class(rules: DataFrame, classes: DataFrame, config: Config) -> DataFrame:
    """target_class from the subject where the ontology knows it, else from the text."""
    known = subject_class(rules, classes)
    joined = computed(rules.join(known, "rule_id", "left"), _low=F.lower("text"))
    return computed(
        joined, target_class=F.coalesce("ontology_class", text_class(F.col("_low"), config))
    ).drop("ontology_class", "_low")


# --- property paths -------------------------------------------------------------------------


def raw_path(formula: Column, action: Column, text: Column) -> Column:
    """Formula predicate, else action slug, else text slug; stock words are refused."""
    predicate = F.regexp_extract(formula, r"[OPF]\(([a-zA-Z_]+)", 1)
    usable = (F.length(predicate) > 1) & ~F.lower(predicate).isin(*v.STOCK_WORDS)
    named = (action != "") & ~F.lower(action).isin(*v.STOCK_WORDS)
    return F.coalesce(
        F.when(usable, naming.formula_name(predicate)),
        F.when(named, naming.slug(action, 3)),
        naming.slug(text, 4),
    )


def folded(vocabulary: DataFrame) -> DataFrame:
    """One row per lower-case spelling: (low, prop, ord), the first spelling listed wins."""
    return vocabulary.groupBy(F.lower("prop").alias("low")).agg(
        F.min_by("prop", "ord").alias("prop"), F.min("ord").alias("ord")
    )


def exact_or_fold(rules: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """exact_prop and fold_prop of each raw path, null where there is none."""
    exact = vocabulary.select(F.col("prop").alias("exact_prop")).distinct()
    fold = folded(vocabulary).select("low", F.col("prop").alias("fold_prop"))
    return (
        rules.withColumn("low", F.lower("raw_path"))
        .join(broadcast_checked(exact), F.col("raw_path") == F.col("exact_prop"), "left")
        .join(broadcast_checked(fold), "low", "left")
    )


def fuzzy(lows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(low, fuzzy_prop, score): for each lower-case path the most similar vocabulary term by matching
    blocks, of equally similar ones the last in order.

    Distinct paths and terms meet on their rare characters, see similarity.alike(); all in columns."""
    fold = folded(vocabulary).select(F.col("low").alias("term"), F.col("prop").alias("fuzzy_prop"))
    paths = lows.select("low").distinct()
    close = alike(fold, paths, "term", "low", v.FUZZY_CUTOFF, "score")
    best = close.groupBy("low").agg(F.max(F.struct("score", "term")).alias("hit"))
    return best.select("low", "hit.score", "hit.term").join(fold, "term").select("low", "fuzzy_prop", "score")


def edit_match(lows: DataFrame, vocabulary: DataFrame, max_distance: int = 3) -> DataFrame:
    """(low, edit_prop): the term with the least edit distance, at most max_distance.

    Built-in variant of fuzzy(). Two names within distance d share at least one piece when one of
    them is cut into d + 1 pieces, moved by at most d places; joining on those pieces gives every
    possible pair without comparing all with all.
    """
    d = max_distance
    fold = folded(vocabulary)

    def cut_at(size: Column, i: Column) -> Column:
        return F.floor(size * i / (d + 1)).cast("int")

    def with_bounds(df: DataFrame, size: str) -> DataFrame:
        i = F.col("i")
        return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumns(
            {
                "at": cut_at(F.col(size), i),
                "width": cut_at(F.col(size), i + 1) - cut_at(F.col(size), i),
            }
        )

    terms = with_bounds(
        fold.select(F.col("low").alias("term"), "prop", "ord", F.length("low").alias("size")),
        "size",
    ).withColumn("piece", F.substring(F.col("term"), F.col("at") + 1, F.col("width")))
    sized = (
        lows.select("low")
        .distinct()
        .withColumn("n", F.length("low"))
        .withColumn(
            "size", F.explode(F.sequence(F.greatest(F.col("n") - d, F.lit(0)), F.col("n") + d))
        )
    )
    probes = (
        with_bounds(sized, "size")
        .withColumn("at", F.explode(F.sequence(F.col("at") - d, F.col("at") + d)))
        .filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("n")))
        .select(
            "low", "size", "i", F.substring(F.col("low"), F.col("at") + 1, F.col("width")).alias("piece")
        )
        .distinct()
    )
    pairs = (
        probes.join(broadcast_checked(terms.select("size", "i", "piece", "term", "prop", "ord")),
                    ["size", "i", "piece"])
        .select("low", "term", "prop", "ord")
        .distinct()
    )
    near = pairs.withColumn("dist", F.levenshtein("low", "term", d)).filter(F.col("dist") >= 0)
    return near.groupBy("low").agg(
        F.min_by("prop", F.struct("dist", "ord")).alias("edit_prop"),
        F.min("dist").alias("distance"),
    )


def keyword_match(rules: DataFrame, vocabulary: DataFrame, config: Config) -> DataFrame:
    """(rule_id, keyword_prop, score): the property sharing the most keyword letters.

    Rule words are the keywords of the text and of the raw path. Rules and properties meet on
    shared words only. Two shared words count, or one of six letters; the score must reach 8.
    """
    fold = folded(vocabulary)
    terms = fold.select(
        "prop", "ord", F.explode(naming.name_keywords(F.col("low"), config)).alias("word")
    )
    words = rules.select(
        "rule_id",
        F.explode(
            F.array_union(
                naming.keywords(F.col("text"), config),
                naming.name_keywords(F.lower("raw_path"), config),
            )
        ).alias("word"),
    )
    # a word that most rules have is dealt out; its pairs are added up before they move on
    shared = (
        spread_join(words, terms, ["word"], ["rule_id"])
        .groupBy("rule_id", "prop", "ord")
        .agg(
            F.sum(F.length("word")).alias("score"),
            F.count("*").alias("n"),
            F.max(F.length("word")).alias("longest"),
        )
        .filter(
            ((F.col("n") >= 2) | (F.col("longest") >= v.KEYWORD_SINGLE_CHARS))
            & (F.col("score") >= v.KEYWORD_SCORE)
        )
    )
    return shared.groupBy("rule_id").agg(
        F.max_by("prop", F.struct("score", -F.col("ord"))).alias("keyword_prop"),
        F.max("score").alias("score"),
    )


def with_path(rules: DataFrame, vocabulary: DataFrame, config: Config) -> DataFrame:
    """prop_path by the ladder exact, case fold, fuzzy, keywords, lower-case raw path.

    The first step and the fuzzy matches are read several times below, so both are cut loose from
    their lineage.
    """
    first = stored(exact_or_fold(rules, vocabulary))
    open_rows = first.filter(F.col("exact_prop").isNull() & F.col("fold_prop").isNull())
    close = stored(fuzzy(open_rows, vocabulary).drop("score"))
    known = keyword_match(
        open_rows.join(close, "low", "left_anti"), vocabulary, config
    ).select("rule_id", "keyword_prop")
    step = F.coalesce("exact_prop", "fold_prop", "fuzzy_prop", "keyword_prop", "low")
    method = (
        F.when(F.col("exact_prop").isNotNull(), "exact")
        .when(F.col("fold_prop").isNotNull(), "fold")
        .when(F.col("fuzzy_prop").isNotNull(), "fuzzy")
        .when(F.col("keyword_prop").isNotNull(), "keyword")
        .otherwise("raw")
    )
    return (
        lookup(first, close, "low")
        .join(known, "rule_id", "left")
        .withColumns({"prop_path": step, "path_method": method})
        .drop("low", "exact_prop", "fold_prop", "fuzzy_prop", "keyword_prop")
    )

