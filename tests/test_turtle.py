"""The Turtle subset of shape blocks: grammar and constraint rows."""

import pytest
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import turtle
from normspark.operators import shapes as shp

NS = Config().namespace
GOOD = [
    'ait:S a sh:NodeShape .',
    'ait:S a sh:NodeShape ; sh:targetClass ait:Student, ait:Staff ; sh:property ait:P .\nait:P sh:path ait:x ; sh:minCount 1 .',
    'ait:S a sh:NodeShape ;\n sh:property [ sh:path ait:x ; sh:message "a ] \\" b"@en ; ] ; # note ]\n.',
    '@prefix z: <http://z/> .\nz:S a sh:NodeShape ; sh:in ( "a" ait:b 3 ) ; sh:property [ sh:node [ a sh:NodeShape ] ] .',
    '<http://x/S> a <http://www.w3.org/ns/shacl#NodeShape> ; sh:minCount "1"^^xsd:integer ; sh:closed true .',
    'ait:S a sh:NodeShape ; sh:message """two\n"lines" .""" .',
]
BAD = [
    "", "ait:S a ait:Thing .", "ait:S a sh:NodeShape", "ait:S a sh:NodeShape ; sh:property [ sh:minCount ] .",
    "ait:S a sh:NodeShape ; sh:property [ sh:path ait:x .", "ait:S a sh:NodeShape ; sh:minCount 1 2 .",
    'ait:S a sh:NodeShape ; sh:message "open .', "other:S a sh:NodeShape .", "ait:S sh:NodeShape .",
    "Here is it: ait:S a sh:NodeShape .", '"x" a sh:NodeShape .', "ait:S a sh:NodeShape ; sh:in ( ait:a .",
    'ait:S a sh:NodeShape ; sh:path "x"^^ .', "ait:S a sh:NodeShape } .", "ait:S a sh:NodeShape ; ; , ait:x .",
]


@pytest.mark.parametrize("texts, want", [(GOOD, True), (BAD, False)])
def test_grammar(spark, texts, want):
    df = spark.createDataFrame([(x,) for x in texts], "x STRING")
    for r in df.select("x", turtle.well_formed(F.col("x"), Config()).alias("ok")).collect():
        assert r.ok == want, r.x


def test_triples(spark):
    text = (
        '@prefix z: <http://z/> . ait:S a sh:NodeShape ; z:p "a\\"b"@en , 3 ; sh:in ( ait:a [ z:q 1 ] ) ;\n'
        ' sh:property [ sh:path ait:x ; sh:node [ z:r true ] ; sh:maxCount "2"^^xsd:integer ] . [ z:s <i> ] z:t "" .'
    )
    df = spark.createDataFrame([(text,)], "x STRING")
    assert df.select(turtle.well_formed(F.col("x"), Config())).first()[0]
    rows = df.select(F.inline(turtle.triples(F.col("x"), Config()))).collect()
    sh, names = v.NS_SHACL, {}

    def short(x):
        return names.setdefault(x, f"_{len(names)}") if x.startswith("_:") else x

    assert [(short(r.s), r.p, short(r.o), r.kind) for r in rows] == [
        (NS + "S", v.RDF_TYPE, sh + "NodeShape", "iri"),
        (NS + "S", "http://z/p", 'a"b', "literal"),
        (NS + "S", "http://z/p", "3", "literal"),
        (NS + "S", sh + "in", "()", "literal"),
        (NS + "S", sh + "property", "_0", "bnode"),
        ("_0", sh + "path", NS + "x", "iri"),
        ("_0", sh + "node", "_1", "bnode"),
        ("_1", "http://z/r", "true", "literal"),
        ("_0", sh + "maxCount", "2", "literal"),
        ("_2", "http://z/s", "i", "iri"),
        ("_2", "http://z/t", "", "literal"),
    ]


def test_response_tables(spark):
    block = (
        "ait:S a sh:NodeShape ; sh:targetClass ait:Student ; sh:targetSubjectsOf ait:pays ; sh:severity sh:Info ;\n"
        '  sh:property ait:P , [ sh:path ait:y , ait:z ; sh:maxCount "one" ; sh:severity sh:Warning ] .\n'
        'ait:P a sh:PropertyShape ; sh:path ait:x ; sh:minCount 1 ; sh:datatype xsd:date ; sh:pattern "^\\\\d" ; sh:message "m" .'
    )
    answered = spark.createDataFrame(
        [("R1", block, True), ("R2", "ait:T a sh:NodeShape .", False)],
        "rule_id STRING, turtle_text STRING, syntax_valid BOOLEAN",
    )
    shapes, constraints = shp.response_tables(answered, Config())
    assert sorted(map(tuple, shapes.collect())) == [
        (NS + "S", "class", NS + "Student", "Info"),
        (NS + "S", "subjects_of", NS + "pays", "Info"),
    ]
    rows = sorted(map(tuple, constraints.drop("prop_id").collect()))
    assert rows == [
        (NS + "S", False, NS + "y", None, "one", None, None, None, "Warning"),
        (NS + "S", False, NS + "z", None, "one", None, None, None, "Warning"),
        (NS + "S", True, NS + "x", "1", None, "date", "^\\d", "m", None),
    ]
    ids = {r.named: r.prop_id for r in constraints.collect()}
    assert ids[True] == NS + "P" and ids[False].startswith("_:R1/")
