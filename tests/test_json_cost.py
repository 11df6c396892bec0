"""Shallow JSON objects need no scan brace by brace, and give the object that the scan finds."""

from pyspark.sql import functions as F

from normspark.functions import jsontext

TEXTS = [
    '{"a": 1}', 'x {"a": {"b": 1}, "c": {}} {"d": 2}', '{"a": "x } y"}', '{"a": "{"}', '{"a": "\\\\\\" }"} z',
    'As {x} in { "a": 1 }', '{"a": [{"b": "}"}]}', "{}", "{ }", '{\t"a": 1}', '{"a": {"b": {"c": 1}}}',
]
OTHERS = [
    None, "", "none", '{"a": ', '{"a": "b}', "{'a': 1}", "{a: 1}", '{"a": 1} }', '{"a": 1, "a": 2}', '{"a": NaN}',
    '{"a": INF}', '{"a": {"b": INF}} {"c": "INF"}', '{"a": {"b" 1}} {"c": 1}', '"{" {"a": 1}', '{"a": 01}', '{"a": "x\ny"} {"b": 1}',
]


def test_shallow_objects_are_the_first_objects(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS + OTHERS)], "i INT, raw STRING")
    rows = jsontext.with_object(df, "raw", "obj").select(
        "i", "obj", jsontext.first_object(F.col("raw")).alias("scanned")
    ).orderBy("i").collect()
    assert [(r["i"], r["obj"]) for r in rows] == [(r["i"], r["scanned"]) for r in rows]


def test_inner_objects_and_braces_in_strings_are_read_at_once(spark):
    texts = ['{"a": {"b": 1}}', '{"a": "x } y"}', '{"a": [{"b": "}"}]}']
    df = spark.createDataFrame([(x,) for x in texts], "raw STRING")
    assert [r[0] for r in df.select(jsontext.flat_object(F.col("raw"))).collect()] == texts


def test_an_object_of_many_strings_is_no_deep_recursion(spark):
    text = "{" + ", ".join(f'"k{i}": {{"v": "}}"}}' for i in range(30000)) + "}"
    df = spark.createDataFrame([(text,)], "raw STRING")
    assert df.select(jsontext.flat_object(F.col("raw")) == text).first()[0]
