"""Keyed building blocks that hold when one key has a large share of the rows."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: places a key's rows are dealt over by spread_join()
SALTS = 16


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and work tables.

    The cluster names it in spark.checkpoint.dir. Only a local session without that setting gets
    a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="normspark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable files in the shared folder; keeps the partition layout."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table several steps read into the shared folder and go on from there.

    Cuts the lineage like checkpoint(), but columnar: later steps read only the columns and row
    groups they need.
    """
    path = f"{work_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of steps that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a driver with little to do may put off
    until the disks are full. Called between steps whose results are checkpointed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Dense row numbers from 0 in the order given, without a global window.

    Rows are range-partitioned and sorted, and that layout is checkpointed so that both uses of it
    see the same partitions. Row counts per partition give each partition its first number; the
    number inside a partition comes from the low bits of monotonically_increasing_id. Range
    partitioning reads its input twice, so df should be a stored or checkpointed table.
    """
    laid_out = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = laid_out.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, not by the data
    first = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id", "_part", "_first")
    )


def cut_by_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with `_chunk`: consecutive rows in the order given, about as many in each chunk.

    The cuts are quantiles that Spark's range partitioning takes from a sample of the order columns, so a
    key with a third of the rows has a third of the chunks, however its positions lie. The numbers are
    written down with the rows, since a second sampling may cut elsewhere."""
    return stored(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str,
    tie: str | None = None,
) -> DataFrame:
    """Last non-null value at or before each row, per key, in two levels.

    Rows are cut into chunks of equal numbers of rows, across keys. The last value of a key in each
    chunk is found by a plain aggregate, carried over the short list of chunks, and handed to the
    rows of the next one, so that no task ever sorts a whole hot key.
    """
    order = [pos] + ([tie] if tie else [])
    chunked = cut_by_rank(df, [*keys, *order])
    by_chunk = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail")
    )
    over_chunks = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = by_chunk.select(
        *keys, "_chunk", F.last("_tail", ignorenulls=True).over(over_chunks).alias("_carried")
    ).filter(F.col("_carried").isNotNull())
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        chunked.join(carried, [*keys, "_chunk"], "left")
        .withColumn(
            name,
            F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")),
        )
        .drop("_chunk", "_carried")
    )


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per key, which may be as large as the rows.

    A key repeated very often makes a skewed partition of the rows, which Spark splits at run time
    and joins with copies of the table's part; the table is not repeated for other keys.
    """
    return rows.join(table, key, how)


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a much smaller table whose keys may each match a large share of the rows.

    Two levels: rows of a key are dealt over salts places by a hash of the columns `by`, and the
    table's rows stand in every place. The plan is the same at any size; Spark sends the table
    round instead where it is under the broadcast threshold.
    """
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return placed.join(copies, [*keys, "_salt"], how).drop("_salt")


def newest(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]
) -> DataFrame:
    """One row per key: the one with the greatest order tuple.

    A max_by aggregate, so every task sends on one row per key instead of all of them.
    """
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint for a table that is counted to be small; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the session has cores.

    Only for small inputs ahead of heavy per-row work; a scan with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
