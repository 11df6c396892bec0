"""The response store: keys, hits, upkeep and statistics, as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.operators.keyed import lookup, newest

SEPARATOR = "\u001f"

# Versions of the request texts; changing one makes older responses unreachable.
CLASSIFY_VERSION = "2"
RECLASSIFY_VERSION = "v1"
FORMULA_VERSION = "3"
DIRECT_VERSION = "v1"


def request_key(
    text: Column,
    model: Column | str,
    kind: Column | str,
    version: str,
    temperature: float = 0.0,
    **extras: Column,
) -> Column:
    """SHA-256 over all named parts of a request, in name order."""
    named = {
        "model": model,
        "prompt_type": kind,
        "prompt_version": F.lit(version),
        "temperature": F.lit(str(temperature)),
        "text": text,
        **extras,
    }
    pieces = []
    for name in sorted(named):
        value = named[name]
        value = F.lit(value) if isinstance(value, str) else value
        pieces.append(F.concat(F.lit(name + "="), F.coalesce(value, F.lit(""))))
    return F.sha2(F.concat_ws(SEPARATOR, *pieces), 256)


def text_hash(text: Column) -> Column:
    """Short hash of a text: the first 16 digits of its MD5."""
    return F.substring(F.md5(text), 1, 16)


def answered(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the stored response of their key, null where there is none."""
    return lookup(requests, store.select("cache_key", "response_json"), "cache_key")


def pending(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct keys and texts that have no response yet."""
    once = requests.groupBy("cache_key").agg(F.min("text").alias("text"))
    return once.join(store.select("cache_key"), "cache_key", "left_anti")


def touch(store: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Store after reads: one access more per hit, last access now. hits has one key per read."""
    reads = hits.groupBy("cache_key").agg(F.count("*").alias("_reads"))
    read = F.col("_reads").isNotNull()
    return (
        store.join(reads, "cache_key", "left")
        .withColumn("access_count", F.col("access_count") + F.coalesce("_reads", F.lit(0)))
        .withColumn("last_accessed", F.when(read, now).otherwise(F.col("last_accessed")))
        .drop("_reads")
    )


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with new rows added; a new row replaces the one of the same key."""
    fields = [c for c in store.columns if c != "cache_key"]
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.col("_new"), F.col("created_at"), F.col("response_json")]
    return newest(both, ["cache_key"], order, fields).select(*store.columns)


def evict(
    store: DataFrame, max_entries: int = v.STORE_MAX_ENTRIES, drop: int = v.STORE_EVICT
) -> DataFrame:
    """Once the store holds max_entries rows, remove the ones not read for longest."""
    full = store.agg(F.count("*").alias("n")).scalar() >= max_entries
    oldest = store.orderBy("last_accessed", "cache_key").limit(drop).select("cache_key")
    # at most `drop` keys
    return store.join(F.broadcast(oldest.filter(full)), "cache_key", "left_anti")


def store_statistics(store: DataFrame) -> DataFrame:
    """Entries, reads, mean reuse, and entries by model and by type, in one pass."""
    sets = store.groupingSets(
        [[], [store.model], [store.prompt_type]], store.model, store.prompt_type
    ).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("reads"),
    )
    reuse = F.when(F.col("n") > 0, F.round(F.col("reads") / F.col("n"), 2)).otherwise(0.0)

    def stat(name: str, key: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("stat"), key.alias("key"), value.cast("double").alias("value")
        )

    rows = (
        F.when(
            F.col("g") == 3,
            F.array(
                stat("total_entries", F.lit(""), F.col("n")),
                stat("total_reads", F.lit(""), F.col("reads")),
                stat("average_reuse", F.lit(""), reuse),
            ),
        )
        .when(F.col("g") == 1, F.array(stat("by_model", F.col("model"), F.col("n"))))
        .otherwise(F.array(stat("by_prompt_type", F.col("prompt_type"), F.col("n"))))
    )
    return sets.select(F.explode(rows).alias("r")).select("r.*")
