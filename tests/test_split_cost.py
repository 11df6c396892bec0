from normspark.functions import turtle
from normspark.operators import shapes as shp
from pyspark.sql import functions as F
from testbed import mapping as m
from testbed import tables as t
from testbed.registry import Bed


def one_file_of_parts(spark, path):
    rows = [(i, f"blue part{i}", "PROMO", f"Brand#{i % 9}", i % 40, 10.0 + i) for i in range(1, 61)] + [(None,) * 6]
    names = "p_partkey LONG, p_name STRING, p_type STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_answers_of_one_small_file_are_the_work_of_several_tasks(spark, tmp_path):
    bed = Bed(spark, one_file_of_parts(spark, tmp_path))
    block = shp.without_fences(F.col("response_json"))
    found = bed.role(m.DIRECT_RESPONSES).select(
        "rule_id", turtle.well_formed(block, bed.config).alias("ok"), F.spark_partition_id().alias("task")
    )
    rows = found.collect()
    assert len({r["task"] for r in rows}) > 1
    plain = spark.sql(m.for_spark(m.DIRECT_RESPONSES), part=t.given(spark, bed.sf_dir, "part"))
    assert sorted(str(r["rule_id"]) for r in rows) == sorted(str(r["rule_id"]) for r in plain.collect())
    assert any(r["ok"] for r in rows) and not all(r["ok"] for r in rows)
