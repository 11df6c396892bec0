"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The sources of a corpus get targets in words by weight, none above MOST times its own words. Each source
is dealt into shards by a hash of its rows, and a shard's documents, laid end to end in the order of
that hash, are cut into blocks of equal length (to a word): BLOCK words, or less for a source that has
fewer than LEAST such blocks. Blocks are then allocated by highest quotients w / (2 k + 1), k being the
blocks already given and w the blocks wanted: first among the sources, then each source's blocks among
its shards. That gives every shard a whole number of blocks to take. A shard takes all its blocks as
often as the quota holds them whole, and the rest of the quota from the blocks with the least seeded
hash. So no word is taken more than MOST times, sources meet their targets to about a block, and
nothing depends on the number of partitions or on what ran before.

Quotients are not listed one by one: a divisor under which too few blocks are given and one under which
enough are bracket the result, so only the quotients between the two are ranked, about four per item.

All of it is DataFrame functions. Texts are read once, for their number of words; shuffles carry
(doc_id, source, size) only. A hot source is spread over its shards and over the places of a salted
join; a shard has about SHARD words, so no window grows with the input. Windows over all sources hold one
row per source.

Null text has size 0 and nothing is taken from it; null source is a source of its own, the last. Rows
that agree in doc_id, source and size are interchangeable. Null doc_ids are dealt by size. An empty
table gives an empty result. Columns named like a result column are replaced by it, others are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.operators.keyed import stored

from . import common, salted

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240917
BLOCK = 512
LEAST = 1000
SHARD = 1 << 20
#: brackets of the divisor: sixteen times wider each
BRACKETS = 8


def n_words(text: Column) -> Column:
    """Runs of characters that are no ASCII white space: each is replaced, with the space after it, by
    one letter; what is left is as long as there are words."""
    gaps = " \t\n\u000b\f\r"
    run = "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(gaps)), run, "x")).cast("long"), F.lit(0))


def seeded(*parts: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


# --- targets ---


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(place, source_size, target): sources share all words by weight, up to `most` times their own.

    Sources that reach their limit are those with the least limit for their weight: one after the
    other is settled while its share of what is left, by weight, is no less than its limit."""
    rows = sizes.groupBy("place").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("place")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))) + 1).cast("long")
    limit = F.col("source_size") * most
    rows = rows.withColumn("weight", weight).withColumn("limit", limit)
    least = math.lcm(*weights)
    by_need = Window.orderBy((F.col("limit") * (least / F.col("weight")).cast("long")).asc(), "place")
    everything = Window.partitionBy(F.lit(0))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    left = F.sum("source_size").over(everything).cast(wide) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("full", F.col("limit").cast(wide) * F.sum("weight").over(onward) <= F.col("weight") * left)
    full = F.col("full")
    rest = F.sum(F.when(full, F.col("source_size") - F.col("limit")).otherwise(F.col("source_size"))).over(everything)
    shared = F.sum(F.when(full, 0).otherwise(F.col("weight"))).over(everything)
    part = F.col("weight") * rest.cast("double") / F.nullif(shared, F.lit(0))
    target = F.when(full, F.col("limit").cast("double")).otherwise(part)
    return rows.select("place", "source_size", target.alias("target"))


# --- apportionment ---


def apportioned(items: DataFrame, group: Column, order: Sequence[str]) -> DataFrame:
    """items with `quota`: in each group, `seats` in all, to the highest quotients w / (2 k + 1) with k
    below the item's `cap`; ties by `order`. The items' w must add up to about the seats.

    At a divisor x an item has floor(w / x + 1/2) seats, its cap at most. w / x - 1/2 and w / x + 1/2 bound
    that, which gives a divisor with too few seats; enough are found by widening, as caps may bind."""
    own = Window.partitionBy(group)
    w, cap, seats = F.col("w"), F.col("cap"), F.col("seats")
    rows = items.withColumns({"__all": F.sum("w").over(own), "__n": F.count("*").over(own)})

    def at(seats_meant: Column) -> Column:
        given = F.floor(w * seats_meant / F.col("__all") + 0.5)
        return F.least(cap, F.when(seats_meant > 0, given).otherwise(0).cast("long"))

    wider = [at(seats + F.col("__n") * 16**i) for i in range(BRACKETS)]
    enough = F.coalesce(*(F.when(F.sum(x).over(own) >= seats, F.lit(i)) for i, x in enumerate(wider)))
    rows = rows.withColumn("__i", enough)
    high = F.coalesce(*(F.when(F.col("__i") == i, x) for i, x in enumerate(wider)), cap)
    rows = rows.withColumns(
        {
            # one seat of slack on both sides for the rounding of the divisions
            "__low": F.greatest(F.lit(0), at(seats - F.col("__n") / 2) - 1),
            "__high": F.least(cap, high + 1),
        }
    )
    rows = rows.withColumn("__open", seats - F.sum("__low").over(own)).drop("__all", "__n", "__i")
    next_seat = F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__k")
    offers = rows.filter("__high > __low").select(group.alias("__group"), *order, "w", "__open", next_seat)
    best = Window.partitionBy("__group").orderBy(F.desc(F.col("w") / (2 * F.col("__k") + 1)), *order)
    won = offers.withColumn("__rank", F.row_number().over(best)).filter("__rank <= __open")
    won = won.groupBy(*order).agg(F.count("*").alias("__won"))
    quota = F.col("__low") + F.coalesce("__won", F.lit(0))
    return rows.join(won, list(order), "left").withColumn("quota", quota).drop("__low", "__high", "__open", "__won")


# --- blocks ---


class Mix:
    """The steps of one mix, from sized documents to blocks and to what is taken of each document."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most=MOST, block=BLOCK, least=LEAST, shard=SHARD, seed=SEED):
        self.most, self.seed = most, seed
        place = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
        sized = docs.select("doc_id", "source", place.alias("place"), n_words(F.col("text")).alias("size"))
        self.sized = sized = stored(sized)
        self.sources = stored(source_targets(sized, weights, most))
        kept = self.sources.withColumns(
            {
                "n_shards": F.ceil(F.col("source_size") / shard),
                "width": F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / least))),
            }
        )
        rows = salted.join(sized, kept, ["place"], F.xxhash64("doc_id", "size"))
        self.without = rows.filter("size = 0")
        digest = seeded(F.col("doc_id"), F.col("size"), seed=seed)
        rows = rows.filter("size > 0").withColumn("__at", digest)
        self.rows = stored(rows.withColumn("shard", F.pmod(number(F.col("__at")), F.col("n_shards"))))

    def quotas(self) -> DataFrame:
        """(place, shard, words, blocks, quota): how many blocks every shard takes."""
        shards = self.rows.groupBy("place", "shard").agg(
            F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"),
            F.ceil(F.sum("size") / F.first("width")).alias("blocks"),
        )
        shards = stored(shards)
        sources = shards.groupBy("place").agg(
            F.sum("blocks").alias("of"), (F.first("target") * F.sum("blocks") / F.first("source_size")).alias("w")
        )
        wanted = F.sum(F.col("w").cast("decimal(28,6)")).over(Window.partitionBy(F.lit(0)))
        sources = sources.withColumn("seats", F.floor(wanted + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
        sources = apportioned(sources.withColumn("cap", F.col("of") * self.most), F.lit(0), ["place"])
        sources = sources.select("place", "of", F.col("quota").alias("seats"))
        inside = salted.join(shards, sources, ["place"], F.col("shard"))
        inside = inside.withColumn("w", F.col("seats") * F.col("blocks") / F.col("of")).withColumn("cap", F.col("blocks") * self.most)
        return apportioned(inside, F.col("place"), ["place", "shard"]).select("place", "shard", "words", "blocks", "quota")

    def blocks(self, quotas: DataFrame) -> DataFrame:
        """(place, shard, block, times): how often each block is taken."""
        rows = quotas.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        by_seed = Window.partitionBy("place", "shard").orderBy(seeded(F.col("place"), F.col("shard"), F.col("block"), seed=self.seed), "block")
        whole = F.floor(F.col("quota") / F.col("blocks"))
        more = (F.row_number().over(by_seed) <= F.col("quota") - whole * F.col("blocks")).cast("long")
        return rows.select("place", "shard", "block", (whole + more).alias("times"))

    def pieces(self) -> DataFrame:
        """(doc_id, place, shard, start, size, source_size, target, first, words, times): each document cut
        by the blocks of its shard; words `first` and on are taken `times` times. Zero times are listed."""
        quotas = stored(self.quotas())
        before = Window.partitionBy("place", "shard").orderBy("__at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        rows = rows.join(quotas.select("place", "shard", "words", "blocks"), ["place", "shard"])
        end = F.col("start") + F.col("size")
        # the block of word x is the greatest b with floor(b * words / blocks) <= x
        first = F.expr("((start + 1) * blocks - 1) div words")
        last = F.expr("((start + size) * blocks - 1) div words")
        rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
        begins = F.greatest(F.col("start"), F.expr("block * words div blocks"))
        ends = F.least(end, F.expr("(block + 1) * words div blocks"))
        rows = rows.withColumns({"first": begins - F.col("start"), "piece": ends - begins})
        # the list of blocks grows with the input, which its estimated size before explode() does not show
        rows = rows.join(self.blocks(quotas).hint("merge"), ["place", "shard", "block"])
        return rows.select(
            "doc_id", "source", "place", "shard", "start", "size", "source_size", "target", "first", F.col("piece").alias("words"), "times"
        )

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of every row."""
        own = ["place", "shard", "start"]
        rest = ["doc_id", "source", "size", "source_size", "target"]
        sums = self.pieces().groupBy(*own).agg(*(F.first(c).alias(c) for c in rest), F.sum(F.col("words") * F.col("times")).alias("taken"))
        return sums.select(*rest, "taken").unionByName(self.without.select(*rest, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).taken()


def op12_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
    SELECT doc_id, source, coalesce('a' || source, 'b') AS place,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents
), s0 AS (
    SELECT place, sum(size)::BIGINT AS source_size FROM d GROUP BY place
), s1 AS (
    SELECT *, source_size * {MOST} AS most, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY place) - 1) % {len(WEIGHTS)} + 1] AS weight
    FROM s0
), s2 AS (
    SELECT *, most::HUGEINT * sum(weight) OVER (by_need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= weight * (sum(source_size) OVER () - coalesce(sum(most) OVER (by_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS "full"
    FROM s1 WINDOW by_need AS (ORDER BY most * {math.lcm(*WEIGHTS)} // weight, place)
), s AS (
    SELECT place, source_size, CASE WHEN "full" THEN most::DOUBLE
        ELSE weight * (sum(CASE WHEN "full" THEN source_size - most ELSE source_size END) OVER ())::DOUBLE
            / sum(CASE WHEN "full" THEN 0 ELSE weight END) OVER () END AS target,
        greatest(1, ceil(source_size / {SHARD}))::BIGINT AS n_shards,
        least({BLOCK}, greatest(1, source_size // {LEAST})) AS width
    FROM s2
), r0 AS (
    SELECT d.*, source_size, target, width, n_shards, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS pos
    FROM d JOIN s USING (place) WHERE size > 0
), r AS (
    SELECT *, ('0x' || substr(pos, 1, 8))::BIGINT % n_shards AS shard FROM r0
), h AS (
    SELECT place, shard, sum(size)::BIGINT AS words, ceil(sum(size) / any_value(width))::BIGINT AS blocks, any_value(target) AS target,
        any_value(source_size) AS source_size
    FROM r GROUP BY ALL
), a AS (
    SELECT place, sum(blocks)::BIGINT AS n, any_value(target) * sum(blocks)::BIGINT / any_value(source_size) AS w FROM h GROUP BY place
), q AS (
    SELECT place, n, count(*)::BIGINT AS seats FROM (
        SELECT place, n FROM (SELECT *, unnest(range(n * {MOST})) AS k FROM a)
        QUALIFY row_number() OVER (ORDER BY w / (2 * k + 1) DESC, place) <= (SELECT floor(sum(w::DECIMAL(28, 6)) + 0.5) FROM a)
    ) GROUP BY ALL
), i AS (
    SELECT h.*, seats, seats * blocks / n AS w FROM h JOIN q USING (place)
), z AS (
    SELECT place, shard, words, blocks, count(k)::BIGINT AS quota FROM h LEFT JOIN (
        SELECT place, shard, k FROM (SELECT *, unnest(range(blocks * {MOST})) AS k FROM i)
        QUALIFY row_number() OVER (PARTITION BY place ORDER BY w / (2 * k + 1) DESC, shard) <= seats
    ) USING (place, shard) GROUP BY ALL
), b0 AS (
    SELECT *, unnest(range(blocks)) AS block FROM z
), b AS (
    SELECT *, quota // blocks + (row_number() OVER (PARTITION BY place, shard
        ORDER BY md5('{SEED}:' || place || ':' || shard || ':' || block), block) <= quota % blocks)::BIGINT AS times,
        block * words // blocks AS lo, (block + 1) * words // blocks AS hi
    FROM b0
), e AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY pos, doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r
), t AS (
    SELECT e.doc_id, e.source, e.size, e.source_size, e.target, sum((least(start + size, hi) - greatest(start, lo)) * times)::BIGINT AS taken
    FROM e JOIN b ON e.place = b.place AND e.shard = b.shard AND b.lo < start + size AND b.hi > start
    GROUP BY e.place, e.shard, start, e.doc_id, e.source, e.size, e.source_size, e.target
)
SELECT * FROM t
UNION ALL
SELECT doc_id, source, size, source_size, target, 0 FROM d JOIN s USING (place) WHERE size = 0
"""
