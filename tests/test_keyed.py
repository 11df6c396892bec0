import pytest
from pyspark.sql import functions as F

from normspark.operators.keyed import cut_by_rank, lookup, newest, ordinal, running_last, spread_join


def test_ordinal_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    rows = ordinal(df.repartition(7), ["k"]).collect()
    assert sorted((r.k, r.ordinal) for r in rows) == [(i, i) for i in range(1000)]


def test_running_last_over_chunks(spark):
    rows = [("hot", i, f"h{i}" if i % 17 == 3 else None) for i in range(200)]
    rows += [("b", 5, None), ("b", 6, "x"), ("b", 900, None)]
    df = spark.createDataFrame(rows, "k STRING, pos INT, title STRING")
    got = running_last(df.repartition(3), ["k"], "pos", "title", "last")
    last, want = {}, {}
    for k, pos, title in rows:
        last[k] = title or last.get(k)
        want[(k, pos)] = last.get(k)
    assert {(r.k, r.pos): r["last"] for r in got.collect()} == want


@pytest.fixture
def no_merging(spark):
    """Spark leaves small partitions apart and sends no table round."""
    named = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in named}
    for k, x in named.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def test_chunks_of_a_sparse_hot_key_are_even(spark, no_merging):
    """Positions double their gaps, and one key has nearly all rows."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id"))).otherwise("hot").alias("k"),
        F.pow(F.lit(1.01), F.col("id")).alias("pos"),
        F.when(F.col("id") % 100 == 3, F.col("id").cast("string")).alias("title"),
    )
    sizes = sorted(r["count"] for r in cut_by_rank(rows, ["k", "pos"]).groupBy("_chunk").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = {r.pos: r["last"] for r in running_last(rows, ["k"], "pos", "title", "last").filter("k = 'hot'").collect()}
    want, last = {}, None
    for r in sorted(rows.filter("k = 'hot'").collect(), key=lambda r: r.pos):
        last = r.title or last
        want[r.pos] = last
    assert got == want


def test_lookup_keeps_all_rows_of_a_hot_key(spark, no_merging):
    rows = spark.range(300).select(
        F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        "id",
    )
    table = spark.createDataFrame([("hot", 1), ("k250", 2)], "key STRING, v INT")
    left = lookup(rows, table, "key").collect()
    assert len(left) == 300
    assert sum(r.v == 1 for r in left) == 200 and sum(r.v == 2 for r in left) == 1
    assert lookup(rows, table, "key", "inner").count() == 201


def test_spread_join_deals_a_hot_key_out(spark, no_merging):
    """Nine rows in ten have one key; no task gets more than twice its share of them."""
    rows = spark.range(16000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("key"), "id")
    table = spark.createDataFrame([(0, "a"), (0, "b"), (10, "c")], "key LONG, v STRING")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, rows.join(table, "key", how).collect()), key=str)
        assert sorted(map(tuple, spread_join(rows, table, ["key"], ["id"], how).collect()), key=str) == want
    joined = spread_join(rows, table, ["key"], ["id"], "left_semi", salts=64)
    tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and max(tasks) <= 2 * sum(tasks) / 4


def test_newest_takes_the_greatest_order(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", 2, "w")], "k STRING, t INT, v STRING"
    )
    got = newest(df, ["k"], [F.col("t").isNull(), F.col("t")], ["v"]).collect()
    assert {r.k: r.v for r in got} == {"a": "z", "b": "w"}
