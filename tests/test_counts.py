"""Results counted by shape against the results themselves."""

from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.operators import validate as va


def test_result_counts_equal_the_results(spark):
    """Shapes with equal checks, values without a target, missing paths and repeated rows."""
    iri, text = "iri", "literal"
    rows = [("n%d" % i, v.RDF_TYPE, "A" if i % 2 else "B", iri, None) for i in range(40)]
    rows += [("n%d" % i, "p", "%d" % (i % 3), text, "integer") for i in range(0, 40, 3)]
    rows += [("n%d" % i, "p", "x%d" % i, text, "string") for i in range(0, 40, 4)]
    rows += [("n3", "q", "z", text, None), ("lost", "p", "1", text, "integer"), (None, "p", "1", text, None)]
    triples = spark.createDataFrame(rows + rows[:5], "s STRING, p STRING, o STRING, o_kind STRING, datatype STRING")
    shapes = [("s%d" % i, "class", "AB"[i % 2], "Violation") for i in range(12)]
    shapes += [("s12", "subjects_of", "p", "Info"), ("s13", "class", "Nobody", "Info"), ("s0", "class", "B", "Info")]
    shapes = spark.createDataFrame(shapes, "shape_id STRING, target_kind STRING, target STRING, severity STRING")
    asked = []
    for i in range(14):
        asked.append(("s%d" % i, "s%d_a" % i, True, "p", 1 + i % 2, None, None, None, None, None))
        asked.append(("s%d" % i, "s%d_b" % i, i % 3 > 0, "p", None, i % 2, "integer", None, None, None))
        asked.append(("s%d" % i, "s%d_b" % i, i % 3 > 0, "p", None, None, "decimal", "^[0-9]$", "m", None))
        asked.append(("s%d" % i, "s%d_b" % i, i % 3 > 0, "p", None, None, "integer", "^x", "m", None))
    asked += [("s1", None, True, None, 1, None, None, None, None, None)] + asked[:4]
    asked = spark.createDataFrame(
        asked,
        "shape_id STRING, prop_id STRING, named BOOLEAN, path STRING, min_count INT, max_count INT, datatype STRING,"
        " pattern STRING, message STRING, severity STRING",
    )
    edges = spark.createDataFrame([("B", "A")], "sub STRING, sup STRING")
    for tree in (None, edges):
        want = va.results(triples, shapes, asked, Config(), tree).groupBy("source_shape").agg(F.count("*").alias("n"))
        got = va.result_counts(triples, shapes, asked, Config(), tree)
        assert got.columns == want.columns
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_many_equal_shapes_move_no_row_per_result(spark):
    """2,000 shapes over 2,000 nodes have 4 million results; the plan makes no row for each."""
    triples = spark.range(2000).select(
        F.concat(F.lit("n"), "id").alias("s"), F.lit(v.RDF_TYPE).alias("p"), F.lit("A").alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"),
    )
    many = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("shape_id"))
    shapes = many.select("shape_id", F.lit("class").alias("target_kind"), F.lit("A").alias("target"), F.lit("Info").alias("severity"))
    none = F.lit(None).cast("string")
    asked = many.select(
        "shape_id", F.col("shape_id").alias("prop_id"), F.lit(True).alias("named"), F.lit("p").alias("path"),
        F.lit(1).alias("min_count"), F.lit(None).cast("int").alias("max_count"), none.alias("datatype"),
        none.alias("pattern"), none.alias("message"), none.alias("severity"),
    )
    got = va.result_counts(triples, shapes, asked, Config())
    assert got.agg(F.count("*"), F.min("n"), F.max("n")).collect() == [(2000, 2000, 2000)]
