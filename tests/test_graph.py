from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.operators import entities as en
from normspark.operators import triage
from normspark.operators import validate as va

NS = Config().namespace
TRIPLE = "s STRING, p STRING, o STRING, o_kind STRING, datatype STRING"


def graph(spark, facts):
    rows = []
    for s, p, o, *kind in facts:
        if p == "a":
            rows.append((NS + s, v.RDF_TYPE, NS + o, "iri", None))
        else:
            rows.append((NS + s, NS + p, o, "literal", kind[0] if kind else "boolean"))
    return spark.createDataFrame(rows, TRIPLE)


def tables(spark, shapes, checks):
    shape_rows = [(NS + n, kind, NS + target, "Warning") for n, kind, target in shapes]
    check_rows = [
        (NS + s, prop, named, NS + path, c.get("min"), c.get("max"), c.get("type"),
         c.get("pattern"), c.get("message"), c.get("severity"))
        for s, prop, named, path, c in checks
    ]
    return (
        spark.createDataFrame(
            shape_rows, "shape_id STRING, target_kind STRING, target STRING, severity STRING"
        ),
        spark.createDataFrame(
            check_rows,
            "shape_id STRING, prop_id STRING, named BOOLEAN, path STRING, min_count INT,"
            " max_count INT, datatype STRING, pattern STRING, message STRING, severity STRING",
        ),
    )


def found(df):
    return sorted(
        (r.focus_node.removeprefix(NS), r.source_shape.removeprefix(NS), r.component, r.value)
        for r in df.collect()
    )


FACTS = [
    ("a", "a", "Student"), ("a", "paid", "false"), ("a", "paid", "true"),
    ("b", "a", "PhD"), ("b", "cooks", "false"), ("b", "cooks", "false"),
    ("c", "a", "Guest"), ("c", "fee", "12x", "decimal"), ("c", "fee", "3", "string"),
    ("c", "fee", "4.5", "decimal"), ("c", "cooks", "true"),
]


def test_results(spark):
    triples = graph(spark, FACTS)
    shapes, checks = tables(
        spark,
        [("S1", "class", "Student"), ("S2", "subjects_of", "fee"), ("S3", "subjects_of", "cooks"),
         ("S4", "class", "Nobody")],
        [
            ("S1", "_:1", False, "paid", {"min": 1}),
            ("S1", "_:2", False, "paid", {"min": 1}),
            ("S1", NS + "S1p", True, "paid", {"max": 1}),
            ("S2", NS + "S2p", True, "fee", {"min": 1, "type": "decimal", "pattern": "^[0-9]"}),
            ("S3", NS + "S3p", True, "cooks", {"max": 0, "message": "no cooking"}),
            ("S4", NS + "S4p", True, "paid", {"min": 1}),
        ],
    )
    edges = spark.createDataFrame([(NS + "PhD", NS + "Student")], "sub STRING, sup STRING")
    inferred = va.results(triples, shapes, checks, Config(), edges)
    assert found(inferred) == [
        ("a", "S1p", "max_count", ""),
        ("b", "S1", "min_count", ""),
        ("b", "S1", "min_count", ""),
        ("b", "S3p", "max_count", ""),
        ("c", "S2p", "datatype", "12x"),
        ("c", "S2p", "datatype", "3"),
        ("c", "S3p", "max_count", ""),
    ]
    asserted = va.results(triples, shapes, checks, Config())
    assert ("b", "S1", "min_count", "") not in found(asserted)
    severities = {r.severity for r in inferred.collect()}
    assert severities == {v.NS_SHACL + "Violation"}
    own = va.results(triples, shapes, checks, Config(severity_mode="inherit"), edges)
    assert {r.severity for r in own.collect()} == {v.NS_SHACL + "Warning"}
    empty = va.summary(triples.limit(0), shapes, inferred.limit(0), None).first()
    assert empty.skipped and not empty.conforms


def test_shuffled_checks_give_the_same_results(spark):
    """Without broadcasts, and with nine nodes in ten in one class."""
    crowd = [(f"x{i}", "a", "Student") for i in range(60)] + [("x1", "paid", "true"), ("x2", "cooks", "1")]
    triples = graph(spark, FACTS + crowd)
    shapes, checks = tables(
        spark,
        [("S1", "class", "Student"), ("S3", "subjects_of", "cooks")],
        [("S1", "_:1", False, "paid", {"min": 3}),
         ("S3", NS + "S3p", True, "cooks", {"max": 0, "type": "string"})],
    )
    small = found(va.results(triples, shapes, checks, Config()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(va.results(triples, shapes, checks, Config())) == small and len(small) > 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_domain_range_and_cycles(spark):
    triples = graph(spark, [("a", "a", "A")]).unionByName(
        spark.createDataFrame([(NS + "a", NS + "knows", NS + "b", "iri", None)], TRIPLE)
    )
    edges = spark.createDataFrame(
        [(NS + "A", NS + "B"), (NS + "B", NS + "A"), (NS + "D", NS + "E")], "sub STRING, sup STRING"
    )
    domains = spark.createDataFrame(
        [(NS + "knows", NS + "D", NS + "R")], "p STRING, domain STRING, range STRING"
    )
    got = va.entity_types(triples, edges, domains).collect()
    assert {(r.focus[len(NS):], r["class"][len(NS):]) for r in got} == {
        ("a", "A"), ("a", "B"), ("a", "D"), ("a", "E"), ("b", "R")
    }


def test_closure_has_no_depth(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    diamond = [("d", "e"), ("d", "f"), ("e", "g"), ("f", "g"), ("g", None)]
    edges = spark.createDataFrame(chain + ring + diamond, "sub STRING, sup STRING")
    got = sorted((r.sub, r.sup) for r in va.subclass_closure(edges).collect())
    want = [(f"c{i:03}", f"c{k:03}") for i in range(151) for k in range(i, 151)]
    want += [(a, b) for a in ("r1", "r2", "r3") for b in ("r1", "r2", "r3")]
    want += [(x, x) for x in "defg"] + [("d", "e"), ("d", "f"), ("d", "g"), ("e", "g"), ("f", "g")]
    assert got == sorted(want)
    assert not va.subclass_closure(edges.limit(0)).count()


def test_recheck_sees_the_whole_graph(spark):
    def triples(*facts):
        rows = [(NS + s, NS + p, NS + o, "iri", None) for s, p, o in facts]
        return spark.createDataFrame(rows, TRIPLE)

    edges = spark.createDataFrame([(NS + "X", NS + "Y")], "sub STRING, sup STRING")
    domains = spark.createDataFrame(
        [(NS + "sponsoredBy", None, NS + "Sponsor")], "p STRING, domain STRING, range STRING"
    )
    shapes, checks = tables(
        spark,
        [("S1", "class", "Sponsor")],
        [("S1", "_:1", False, "status", {"min": 1})],
    )

    def after(old, new):
        known = va.results(old, shapes, checks, Config(), edges, domains)
        state = va.content_hash(old, va.entity_types(old, edges, domains))
        again = va.recheck(new, state, known, shapes, checks, Config(), edges, domains)
        whole = va.results(new, shapes, checks, Config(), edges, domains)
        assert found(again) == found(whole)
        return len(found(whole))

    link, status = ("a", "sponsoredBy", "n"), ("n", "status", "ok")
    assert after(triples(link, status, ("a", "q", "1")), triples(link, status, ("a", "q", "2"))) == 0
    assert after(triples(link, ("a", "q", "1")), triples(link, ("a", "q", "2"))) == 1
    assert after(triples(("a", "q", "1")), triples(link, ("a", "q", "1"))) == 1
    assert after(triples(link, ("a", "q", "1")), triples(("a", "q", "1"))) == 0


def test_triage_marks(spark):
    rows = [("s1", f"e{i}") for i in range(8)] + [("s2", f"e{i}") for i in range(7)] * 2
    results = spark.createDataFrame(rows, "source_shape STRING, focus_node STRING").withColumns(
        {"result_message": F.lit("m"), "severity": F.lit(v.NS_SHACL + "Info")}
    )
    got = {r["shape"]: r for r in triage.by_shape(results, 10).collect()}
    assert got["s1"].likely_false_positive and got["s1"].pct_entities == 80.0
    assert not got["s2"].likely_false_positive and got["s2"]["count"] == 14
    assert triage.totals(triage.by_shape(results, 10)).first().actionable == 14
    assert not triage.by_shape(results, 0).filter("likely_false_positive").count()


def student_tables(spark):
    flag = "BOOLEAN"
    students = spark.createDataFrame(
        [("S1", "Ada", "Berg", "Water", "PhD", "Active", True),
         ("S2", "Bo", "Chen", None, "Master", "Suspended", False)],
        "student_id STRING, first_name STRING, last_name STRING, program STRING,"
        " degree_level STRING, enrollment_status STRING, is_new_student BOOLEAN",
    )
    fees = spark.createDataFrame(
        [("S1", "2025-1", 5, 10, "Partial", True), ("S1", "2025-2", 10, 10, "Paid", True)],
        "student_id STRING, semester STRING, amount_paid INT, tuition_amount INT,"
        " payment_status STRING, first_installment_paid BOOLEAN",
    )
    housing = ", ".join(
        f"{n} {'STRING' if n in ('building', 'room_number', 'room_type') else flag}"
        for n in en.HOUSING
    )
    homes = spark.createDataFrame([], f"student_id STRING, check_in_date DATE, {housing}")
    conduct = spark.createDataFrame(
        [("S2", False, None, True, True, True, True, False, False, False)],
        "student_id STRING, ethical_conduct BOOLEAN, peaceful_environment BOOLEAN,"
        " library_responsible_use BOOLEAN, it_acceptable_use BOOLEAN,"
        " brings_concerns_to_attention BOOLEAN, cooking_in_dorm BOOLEAN, noisy_in_dorm BOOLEAN,"
        " pet_in_dorm BOOLEAN, disturbing_residents BOOLEAN",
    )
    academic = spark.createDataFrame(
        [],
        "student_id STRING, registered_with_registry BOOLEAN, grade_determined_in_courses BOOLEAN,"
        " makeup_classes_scheduled BOOLEAN, serves_as_corresponding_author BOOLEAN,"
        " corresponds_with_journal BOOLEAN, first_author_in_multi_authored BOOLEAN",
    )
    return {"students": students, "fee_records": fees, "accommodations": homes,
            "student_conduct": conduct, "academic_records": academic}


def test_student_entities(spark):
    rows = en.student_entities(en.student_profiles(student_tables(spark))).collect()
    got = {r.entity_id: (r["class"], {x.p: x.o for x in r.props}) for r in rows}
    kind, props = got["S1"]
    assert kind == "PostgraduateStudent"
    assert {"payFee", "fullPayment", "feesPaid", "vacateRoom", "registry"} <= set(props)
    assert "confirmOfferMove" not in props and "cookInUnit" not in props
    kind, props = got["S2"]
    assert kind == "Student" and props["enrolled"] == "false" and "payFee" not in props
    assert {"cookInUnit", "cookInProhibitedDormitory"} <= set(props)
    assert "meetHighestStandardsOfPersonalEthicalAndMoralConduct" not in props
    assert "maintainPeacefulHealthyLearningEnvironmentForFreeDiscussion" in props
    block = en.text_blocks(
        en.student_entities(en.student_profiles(student_tables(spark))).withColumn(
            "section", F.lit("students")
        ),
        Config(),
    ).filter("entity_id = 'S2'").first().block
    assert block.startswith("# -- Bo Chen (S2) --\n# Program: N/A | Master | Status: Suspended\n")
    assert 'ait:S2 a ait:Student ;\n    rdfs:label "Bo Chen - Master Student (Suspended)" ;' in block
    assert block.rstrip().endswith(" .")
