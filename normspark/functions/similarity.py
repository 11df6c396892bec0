"""Similarity of two names by matching blocks, as column expressions.

The measure takes the longest common block of both names (the first one in a, then in b, where several
are as long), then does the same left and right of it, and so on; with M characters in blocks it is
2 M / (length of a + length of b). In a b of 200 characters or more, characters that make up over 1 % of
it start no block and only extend one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.functions.columns import computed, let

#: fixed values of the measure
POPULAR_FROM = 200
POPULAR_SHARE = 100

RUN = "array<struct<i:int,j:int,n:int>>"
SPAN = "array<struct<a0:int,a1:int,b0:int,b1:int>>"


def characters(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))


def popular(b: Column) -> Column:
    """Characters of a long b that start no block."""
    many = F.floor(F.size(b) / POPULAR_SHARE) + 1
    found = F.filter(F.array_distinct(b), lambda c: F.size(F.filter(b, lambda x: x == c)) > many)
    return F.when(F.size(b) >= POPULAR_FROM, found).otherwise(F.array().cast("array<string>"))


def runs(a: Column, b: Column) -> Column:
    """All maximal common runs (i, j, n) of two character arrays, row by row of the matrix of equal
    characters; row holds how long the run ending in each column is. Nulls equal nothing."""
    start = F.struct(F.array_repeat(F.lit(0), F.size(b)).alias("row"), F.array().cast(RUN).alias("runs"))

    def step(state: Column, i: Column) -> Column:
        one, after = F.get(a, i), F.get(a, i + 1)
        row = F.transform(b, lambda y, j: F.when(one == y, F.coalesce(F.get(state["row"], j - 1), F.lit(0)) + 1).otherwise(0))

        def run(n: Column, j: Column) -> Column:
            goes_on = F.coalesce(after == F.get(b, j + 1), F.lit(False))
            found = F.struct((i - n + 1).alias("i"), (j - n + 1).alias("j"), n.alias("n"))
            return F.when((n > 0) & ~goes_on, found)

        return let(
            row,
            lambda r: F.struct(
                r.alias("row"), F.concat(state["runs"], F.filter(F.transform(r, run), F.isnotnull)).alias("runs")
            ),
        )

    rows = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: i < F.size(a))
    return F.aggregate(rows, start, step, lambda s: s["runs"])


def inside(run: Column, span: Column) -> Column:
    """What of a run lies in a span: (n, -i, -j), so that the greatest is the longest, first one."""
    skip = F.greatest(F.lit(0), span["a0"] - run["i"], span["b0"] - run["j"])
    n = F.least(run["n"], span["a1"] - run["i"], span["b1"] - run["j"]) - skip
    return F.struct(n.alias("n"), (-run["i"] - skip).alias("i"), (-run["j"] - skip).alias("j"))


def extended(block: Column, span: Column, whole: Column, far: Column) -> Column:
    """A block with the popular characters beside it; without any it may still start at the span's corner."""
    none = F.struct(F.lit(0).alias("n"), (-span["a0"]).alias("i"), (-span["b0"]).alias("j"))
    core = F.when(F.coalesce(block["n"], F.lit(0)) > 0, block).otherwise(none)

    def around(c: Column) -> Column:
        def holds(x: Column) -> Column:
            same = x["i"] - x["j"] == c["i"] - c["j"]
            return same & (x["n"] > 0) & (x["i"] >= c["i"]) & (x["n"] - x["i"] >= c["n"] - c["i"])

        wide = F.filter(F.transform(whole, lambda r: inside(r, span)), holds)
        return F.coalesce(F.array_max(wide), c)

    return F.when(far, let(core, around)).otherwise(core)


def matched(a: Column, b: Column, cores: Column, whole: Column) -> Column:
    """Characters in matching blocks; open spans are worked off one after the other."""
    all_ = F.struct(F.lit(0).alias("a0"), F.size(a).alias("a1"), F.lit(0).alias("b0"), F.size(b).alias("b1"))
    start = F.struct(F.array(all_).cast(SPAN).alias("open"), F.lit(0).alias("m"))
    far = F.size(cores) != F.size(whole)

    def step(state: Column, _: Column) -> Column:
        span = F.element_at(state["open"], F.lit(-1))

        def split(s: Column) -> Column:
            longest = F.array_max(F.transform(cores, lambda r: inside(r, s)))

            def halves(block: Column) -> Column:
                n, i, j = block["n"], -block["i"], -block["j"]
                sides = F.array(
                    F.struct(s["a0"].alias("a0"), i.alias("a1"), s["b0"].alias("b0"), j.alias("b1")),
                    F.struct((i + n).alias("a0"), s["a1"].alias("a1"), (j + n).alias("b0"), s["b1"].alias("b1")),
                )
                left = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
                some = F.filter(sides, lambda x: (n > 0) & (x["a0"] < x["a1"]) & (x["b0"] < x["b1"]))
                return F.struct(F.concat(left, some).cast(SPAN).alias("open"), (state["m"] + n).alias("m"))

            return let(extended(longest, s, whole, far), halves)

        return F.when(F.size(state["open"]) == 0, state).otherwise(let(span, split))

    # every block closes one span and opens two at most
    steps = F.sequence(F.lit(0), 2 * F.least(F.size(a), F.size(b)))
    return F.aggregate(steps, start, step, lambda s: s["m"])


def with_ratio(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with the similarity of the names in columns a and b."""
    rows = computed(pairs, _a=characters(F.col(a)), _b=characters(F.col(b)))
    rows = computed(rows, _popular=popular(F.col("_b")))
    fewer = F.transform("_b", lambda c: F.when(~F.array_contains("_popular", c), c))
    rows = computed(rows, _core=runs(F.col("_a"), F.when(F.size("_popular") > 0, fewer).otherwise(F.col("_b"))))
    rows = computed(rows, _runs=F.when(F.size("_popular") > 0, runs(F.col("_a"), F.col("_b"))).otherwise(F.col("_core")))
    rows = computed(rows, _m=matched(F.col("_a"), F.col("_b"), F.col("_core"), F.col("_runs")))
    total = F.size("_a") + F.size("_b")
    ratio = F.when(total > 0, F.lit(2.0) * F.col("_m") / total).otherwise(1.0)
    return rows.withColumn(name, ratio).drop("_a", "_b", "_popular", "_core", "_runs", "_m")


# --- candidate pairs ---


def numbered(name: Column) -> Column:
    """The characters of a name as a set: each with its number among its like, rarer ones first, as
    high numbers and late letters are rare. Two names share as many of these as characters."""

    def tagged(chars: Column) -> Column:
        def tag(c: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
            return F.concat(F.lpad(nth.cast("string"), 9, "0"), c)

        return F.sort_array(F.transform(chars, tag), asc=False)

    return let(characters(name), tagged)


def with_probes(names: DataFrame, name: str, cutoff: float) -> DataFrame:
    """names with their character set `set` and one row per `probe`: the rarest characters, as many as two
    names at least as similar as cutoff cannot all differ in.

    Names of n and m characters share cutoff (n + m) / 2 at least, and m is n cutoff / (2 - cutoff) at
    least."""
    n = F.size("set")
    need = F.ceil(n * (cutoff / (2 - cutoff)) - 1e-6)
    rows = computed(names, set=numbered(F.col(name)))
    probes = F.slice("set", F.lit(1), (n - need + 1).cast("int"))
    return computed(rows, probes=probes).withColumn("probe", F.explode("probes"))


def alike(a: DataFrame, b: DataFrame, a_name: str, b_name: str, cutoff: float, score: str) -> DataFrame:
    """Pairs of names with a similarity of cutoff or more, once each.

    Names meet on a probe; the pair is taken where that is the first one they share. The shared characters
    bound the similarity from above, so most pairs go before blocks are matched. Both sides must be
    distinct. A probe that very many names have is a skewed join key, which Spark splits at run time."""
    left = with_probes(a.select(a_name), a_name, cutoff).withColumnsRenamed({"set": "_sa", "probes": "_pa"})
    right = with_probes(b.select(b_name), b_name, cutoff).withColumnsRenamed({"set": "_sb", "probes": "_pb"})
    first = F.array_max(F.array_intersect("_pa", "_pb")) == F.col("probe")
    most = F.lit(2.0) * F.size(F.array_intersect("_sa", "_sb")) / (F.size("_sa") + F.size("_sb"))
    pairs = left.join(right, "probe").filter(first & (most >= cutoff)).select(a_name, b_name)
    return with_ratio(pairs, a_name, b_name, score).filter(F.col(score) >= cutoff)
