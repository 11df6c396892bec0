"""Trained operators: held-out accuracy and awkward rows; the pipeline's stages."""

import pytest

pytest.importorskip("normspark.llm")

from pyspark.sql import functions as F  # noqa: E402

from normspark.llm import factorisation, ppm  # noqa: E402

DATA = "/root/testdata/sf0.01"


def test_language(spark):
    found = ppm.op7_ppm_language(spark, DATA).filter("held_out")
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "x")], "doc_id LONG, text STRING")
    model = ppm.train(spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "fr")], "text STRING, lang STRING"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in ppm.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "de")
    assert ppm.train(odd.select("text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r.lang_pred for r in ppm.predict(odd, None).collect()} == {"und"}


def test_quality(spark):
    found = factorisation.op6_factorisation(spark, DATA).filter("held_out")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    right = found.join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50000)], "doc_id LONG, text STRING")
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    machine = factorisation.train(odd, none)
    assert {r.score for r in factorisation.classify(odd, machine).collect()} == {0.5}
    assert factorisation.classify(odd.limit(0), machine).count() == 0
