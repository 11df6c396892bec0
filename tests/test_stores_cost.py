"""Response stores of the test tables are made without sorting the requests."""

from pyspark.sql import functions as F

from testbed import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



def test_stores_are_made_without_a_sort(spark):
    """One row per key as before, by distinct rows: min(text) sorted all requests twice."""
    rows = spark.createDataFrame(
        [("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", None), ("k4", "")], "cache_key STRING, text STRING"
    )
    for store in (tables.classification_store(rows), tables.second_store(rows)):
        assert "Sort" not in plan(store)
        keys = [r["cache_key"] for r in store.collect()]
        assert len(keys) == len(set(keys))
    answers = {r[0]: r[1] for r in tables.classification_store(rows).collect()}
    old = rows.groupBy("cache_key").agg(F.min("text").alias("text")).select(
        "cache_key", tables._answer(tables.response_kind(F.col("text")), tables.ANSWERS).alias("j")
    ).filter("j IS NOT NULL")
    assert answers == {r[0]: r[1] for r in old.collect()}
