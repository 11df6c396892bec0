import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from normspark.config import Config, output_name, run_config
from normspark.operators import classify, formalize, responses
from normspark.operators import shapes as shp
from normspark.plans.person_check import check_by_id, check_by_name, person_check
from normspark.plans.pipeline import Inputs, Run
from normspark.sources import readers, sinks
from normspark.streaming.sentences import page_stream, write_candidates
from testbed.mapping import GIVEN, TIES
from testbed.registry import Bed

SF = "/root/testdata/sf0.001"
PAGE = "Students must pay the fee now. Guests may wander in the old park. It may be cold outside."


def pages(spark):
    return spark.createDataFrame([("a", 1, PAGE)], "source STRING, page LONG, raw_text STRING")


def answers(spark, rows, key):
    df = spark.createDataFrame(rows, "text STRING, rule_type STRING, response_json STRING")
    return df.select(
        key.alias("cache_key"), F.lit(0).alias("attempt"), "response_json"
    )


def test_whole_run(spark, tmp_path):
    b = Bed(spark, SF)
    fee, park = "Students must pay the fee now.", "Guests may wander in the old park."
    rule = {"is_rule": True, "rule_type": "obligation", "confidence": 0.9}
    maybe = {"is_rule": True, "rule_type": "permission", "confidence": 0.4}
    hints = spark.createDataFrame(
        [(fee, "strong", "directive", json.dumps(rule)),
         (park, "weak", "commissive", json.dumps(maybe))],
        "text STRING, deontic_strength STRING, speech_act STRING, response_json STRING",
    )
    key = responses.request_key(
        F.col("text"), "default", "classification", "2",
        deontic_strength=F.col("deontic_strength"), speech_act=F.col("speech_act"),
    )
    second = answers(spark, [(park, "", json.dumps({**maybe, "confidence": 0.7}))],
                     classify.second_key())
    formula = {"deontic_formula": "O(payFee(student))", "fol_expansion": "x",
               "predicates": {"subject": "student", "action": "payFee"}}
    words = spark.createDataFrame([("payFee", 0)], "prop STRING, ord LONG")
    inputs = Inputs(
        pages(spark),
        hints.select(key.alias("cache_key"), "response_json"),
        second,
        answers(spark, [(fee, "obligation", json.dumps(formula))], formalize.formula_key()),
        answers(spark, [(park, "", "```\nait:X a sh:NodeShape .\n```")], shp.direct_key()),
        words, b.classes, b.entity_triples, b.shapes, b.constraints, b.edges, b.domains,
    )
    run = Run(inputs, Config(), str(tmp_path))
    out = run.execute()
    report = out["report"].first()
    assert report.sentences_extracted == 3 and report.candidates_prefiltered == 2
    assert report.rules_classified == 2
    assert (report.formulas_ok, report.formulas_failed) == (1, 1)
    assert (report.shapes_total, report.shapes_direct_nl) == (2, 1)
    assert report.violations == out["results"].count() > 0
    assert run.statistics()["sentences"] == 3
    assert [r.rule_id for r in out["rules"].orderBy("ordinal").collect()] == ["AIT-0000", "AIT-0001"]
    other = Run(inputs, run_config("no-reclassify"), str(tmp_path)).execute()
    assert other["rules"].count() == 1 and other["errors"].filter("step = 'reclassify'").count() == 1
    # the first run's partition is still there
    schema = out["rules"].schema
    assert sinks.committed(spark, f"{tmp_path}/rules", schema, "baseline").count() == 2
    assert {r.run: r.rows for r in sinks.manifest(spark, f"{tmp_path}/rules").collect()} == {
        "baseline": 2, "no-reclassify": 1
    }
    assert output_name("ait", "no-hints") == "ait_no-hints"


def test_person_check(spark):
    b = Bed(spark, SF)
    report = person_check(b.entity_tables, b.shapes, b.constraints, b.config, TIES)
    assert report.count() == b.persons.count()
    assert report.filter(F.size("not_conforms") > 0).count() > 0


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "b.txt").write_text("page one\fpage two")
    got = readers.pages(spark, str(tmp_path / "text")).orderBy("page").collect()
    assert [(r.source, r.page, r.raw_text) for r in got] == [
        ("b.txt", 1, "page one"), ("b.txt", 2, "page two")
    ]
    (tmp_path / "s.json").write_text('[{"text": "x", "page": 2}, {"source": "f"}]')
    rows = readers.sentences_json(spark, str(tmp_path / "s.json")).collect()
    assert sorted((r.text, r.page, r.source) for r in rows) == [("", 0, "f"), ("x", 2, "")]
    (tmp_path / "words.txt").write_text("payFee\n at \n\n vacateRoom\n")
    words = readers.vocabulary(spark, str(tmp_path / "words.txt")).orderBy("ord").collect()
    assert [r.prop for r in words] == ["payFee", "vacateRoom"]
    blocks = spark.createDataFrame(
        [("s", 2, "B\n"), ("s", 1, "A\n"), ("t", 1, "C\n")],
        "source STRING, ordinal LONG, turtle_text STRING",
    )
    sinks.shape_text(blocks, Config(), str(tmp_path / "shapes"))
    parts = sorted((tmp_path / "shapes" / "source=s").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert whole.startswith("@prefix rdf:") and whole.index("A\n") < whole.index("B\n")


def test_json_array_in_many_splits(spark, tmp_path):
    """Objects with braces and quotes in strings and with inner objects, cut anywhere."""
    r = random.Random(6)
    bits = ["a", "}", "{", '"', "\\", "\n", " ", "é", "},{", "[", "]"]
    rows = [
        {"text": "".join(r.choice(bits) for _ in range(r.randint(0, 30))), "page": i, "more": {"k": [{"z": "}"}, {}]}}
        if i % 3 else {"page": i, "text": "plain"}
        for i in range(400)
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[:7]))
    (tmp_path / "none.json").write_text("[]")
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        found = readers.json_objects(spark, str(tmp_path / "*.json"))
        assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 5
        got = sorted((json.loads(x.object) for x in found.collect()), key=str)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert got == sorted(rows + rows[:7], key=str)


def test_a_rerun_replaces_its_own_run_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    one = spark.createDataFrame([(1,), (2,)], "x INT")
    sinks.commit(one, "a", folder)
    sinks.commit(one, "b", folder)
    assert sinks.commit(one.limit(1), "a", folder) == 1
    # staged but never committed
    one.write.parquet(f"{folder}/parts/lost")
    rows = sinks.committed(spark, folder, "x INT").collect()
    assert sorted((r.run, r.x) for r in rows)[1:] == [("b", 1), ("b", 2)] and len(rows) == 3
    assert sinks.committed(spark, folder, "x INT", "c").count() == 0


def test_person_check_by_id_and_name(spark):
    b = Bed(spark, SF)
    whole = {r.id: r for r in person_check(b.entity_tables, b.shapes, b.constraints, b.config, TIES).collect()}
    person = b.persons.filter("type = 'Faculty'").first()
    for one in ("ST7", person.id, "nobody"):
        got = check_by_id(b.entity_tables, one, b.shapes, b.constraints, b.config, TIES).collect()
        assert got == [r for i, r in whole.items() if i == one]
    got = check_by_name(b.entity_tables, f" {person.name.upper()} ", b.shapes, b.constraints, b.config, TIES)
    assert got.collect() == [whole[person.id]]
    assert check_by_name(b.entity_tables, "no such name", b.shapes, b.constraints, b.config, TIES).count() == 0


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    pages(spark).write.parquet(folder)
    query = write_candidates(
        page_stream(spark, folder), Config(), str(tmp_path / "out"), str(tmp_path / "ck")
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


QUERIES = (
    "candidate_decision", "section_asof", "rule_ids", "second_opinion", "composed_formulas",
    "store_eviction", "shape_turtle", "validation_results", "person_compliance", "changed_entities",
)


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = check.rows([d[0] for d in cur.description], cur.fetchall())
    assert check.rows(df.columns, [tuple(r) for r in df.collect()]) == want
