"""Agreement and quality figures over annotations and formulas."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fleiss_kappa(annotations: DataFrame) -> DataFrame:
    """Agreement of a fixed number of raters: annotations(item_id, rater, label)."""
    cells = annotations.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    items = cells.groupBy("item_id").agg(
        F.sum("n").alias("raters"), F.sum(F.col("n") * F.col("n")).alias("squares")
    )
    agreed = (F.col("squares") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))
    observed = items.agg(
        F.avg(agreed).alias("observed"), F.count("*").alias("items"), F.sum("raters").alias("votes")
    )
    votes = observed.select("votes").scalar()
    expected = (
        cells.groupBy("label")
        .agg(F.sum("n").alias("n"))
        .agg(F.sum(F.pow(F.col("n") / votes, 2)).alias("expected"))
    )
    e = expected.scalar()
    return observed.select(
        "items",
        "observed",
        e.alias("expected"),
        F.when(e < 1, (F.col("observed") - e) / (1 - e)).otherwise(F.lit(1.0)).alias("kappa"),
    )


def majority(annotations: DataFrame) -> DataFrame:
    """(item_id, majority): the most frequent label, the smallest one on a tie."""
    cells = annotations.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    return cells.groupBy("item_id").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority")
    )


def accuracy(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Share of predicted labels equal to the majority: predictions(item_id, label)."""
    hit = (F.col("label") == F.col("majority")).cast("double")
    return predictions.join(majority(annotations), "item_id").agg(
        F.count("*").alias("items"),
        F.sum(hit).cast("long").alias("correct"),
        F.avg(hit).alias("accuracy"),
    )


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Agreement of two raters: pairs(item_id, a, b). One crosstab, marginals from it."""
    cross = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cross.agg(F.sum("n").alias("n")).scalar()
    left = cross.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    right = cross.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    e = (
        left.join(right, "label")
        .agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
        .select((F.coalesce("e", F.lit(0)) / (total * total)).alias("expected"))
        .scalar()
    )
    o = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")
    return (
        cross.agg(F.sum("n").alias("items"), o.alias("observed"))
        .withColumn("expected", e)
        .withColumn(
            "kappa",
            F.when(
                F.col("expected") < 1,
                (F.col("observed") - F.col("expected")) / (1 - F.col("expected")),
            ).otherwise(F.lit(1.0)),
        )
    )


# cumulative Poisson(1) probabilities, down to a tail below the 2**-32 steps of uniform()
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform number."""
    return sum(((u > p).cast("int") for p in POISSON[1:]), (u > POISSON[0]).cast("int"))


def uniform(seed: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bootstrap(scores: DataFrame, replicates: int = 200) -> DataFrame:
    """95 % interval of the mean of scores(item_id, score).

    Every item draws its weight for every replicate from a hash, so replicates need no resampled
    copies and a lost task draws the same weights again.
    """
    drawn = scores.withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    ).withColumn(
        "w",
        poisson_weight(
            uniform(F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("replicate")))
        ),
    )
    means = (
        drawn.groupBy("replicate")
        .agg(F.sum(F.col("w") * F.col("score")).alias("x"), F.sum("w").alias("w"))
        .filter(F.col("w") > 0)
        .select((F.col("x") / F.col("w")).alias("mean"))
    )
    return means.agg(
        F.count("*").alias("replicates"),
        F.percentile("mean", 0.025).alias("low"),
        F.percentile("mean", 0.975).alias("high"),
    )


def formula_quality(formulas: DataFrame) -> DataFrame:
    """Formulas and the share of them that are no placeholders."""
    good = (~F.col("placeholder")).cast("double")
    return formulas.agg(
        F.count("*").alias("formulas"),
        F.sum(good).cast("long").alias("semantic"),
        F.avg(good).alias("quality"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-independent hash of a table; equal tables of two runs have equal ones."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*row).cast("decimal(38,0)")).cast("string").alias("content"),
    )


def stable(one: DataFrame, other: DataFrame) -> DataFrame:
    """Whether two runs gave the same table."""
    a, b = fingerprint(one), fingerprint(other)
    return a.select(
        F.col("rows"),
        F.col("content").eqNullSafe(b.select("content").scalar()).alias("stable"),
    )
