import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from normspark.config import Config, run_config
from normspark.functions import deontic, jsontext, similarity
from normspark.functions import segment as seg
from normspark.operators import align, classify, prefilter, sections, segment

PAGE = (
    "2. Requirements\nStudents must file the form, and\npay the fee. Guests may stay two nights."
    "\n\n\n(a) Staff must not smoke here; No smoking applies to: All visitors of the campus 4."
    "\nPage 12 of the old and long handbook\nGENERAL RULES\nÉtudiants must leave. It may be cold."
)


def test_segmentation_of_a_page(spark):
    pages = spark.createDataFrame([("a.pdf", 1, PAGE)], "source STRING, page INT, raw_text STRING")
    rows = segment.sentences(pages).orderBy("item_pos", "sent_pos").collect()
    texts = [r.text for r in rows]
    assert texts[0] == "Requirements Students must file the form, and pay the fee."
    assert "Guests may stay two nights." in texts and "Staff must not smoke here;" in texts


def plain_sentences(raw):
    """The same steps in plain Python."""
    raw = re.sub(r"(?<=[a-z,;:])\n(?=[a-z])", " ", raw)
    raw = re.sub(r"[ \t]+", " ", re.sub(r"\n{2,}", "\n", raw))
    kept = []
    for item in re.split(r"\n\s*(?:\d+\.|\([a-z]\)|[a-z]\)|\*|-)\s+", raw):
        cuts = r"(?<=[.!?])\s+(?=[A-Z0-9])|(?<=:)\s+(?=[A-Z])|(?<=;)\s+(?=[A-Z])"
        for part in re.split(cuts, item.strip()):
            text = re.sub(r"\s+", " ", re.sub(r"\s*\n?\s*\d+\.\s*$", "", part.strip()))
            n = len(text.split())
            start = r"page\s+\d+|\d+\s*$|www\.|http|©|\bait\b\s*\d{4}|_{3,}|-{3,}"
            noise = n < 5 or n > 250 or re.match(start, text, re.I)
            if len(text) >= 5 and not noise and not (text.isupper() and n < 8):
                kept.append(text)
    return kept


def test_segmentation_equals_plain_python(spark):
    texts = [PAGE, "", "ALL CAPS LINE HERE NOW\n1. One two three four five. " + "w " * 260 + "."]
    pages = spark.createDataFrame(
        [("s", i, t) for i, t in enumerate(texts)], "source STRING, page INT, raw_text STRING"
    )
    got = segment.sentences(pages).orderBy("page", "item_pos", "sent_pos").collect()
    assert [r.text for r in got] == [s for t in texts for s in plain_sentences(t)]


@pytest.mark.parametrize(
    "text, sense",
    [
        ("Students may request leave.", "deontic"),
        ("Students may not smoke.", "deontic"),
        ("It may be cold.", "epistemic"),
        ("Members may be eligible for aid.", "epistemic"),
        ("Results may vary with age.", "epistemic"),
        ("Members may choose to leave.", "deontic"),
        ("Guests may wander.", "ambiguous"),
        ("The mayor leaves.", "n/a"),
    ],
)
def test_may_sense(spark, text, sense):
    row = spark.range(1).select(deontic.may_sense(F.lit(text)).alias("s")).first()
    assert row.s == sense


def decide(spark, rows, config=None):
    df = spark.createDataFrame(rows, "text STRING, section_context STRING")
    out = prefilter.decide(sections.with_weight(df), config or Config()).collect()
    return {r.text: r for r in out}


def test_candidate_decision(spark):
    got = decide(
        spark,
        [
            ("Students must pay the fee now.", "Requirements"),
            ("Library books are lent out daily.", "General Rules"),
            ("Library books are lent out weekly.", "Overview of this"),
            ("Guests may wander in the park.", "Glossary"),
            ("Guests may wander in the garden.", ""),
            ("It may be cold in the hall.", ""),
            ("Too short to keep.", ""),
            ("Failure to pay will lead to trouble.", "Fees"),
            (" ".join(["must"] * 151), ""),
        ],
    )
    strong = got["Students must pay the fee now."]
    assert strong.is_candidate and strong.section_weight == 1.3
    assert abs(strong.confidence_boost - 0.195) < 1e-9
    unmarked = got["Library books are lent out daily."]
    assert unmarked.is_candidate and unmarked.confidence_boost == -0.1
    assert not got["Library books are lent out weekly."].is_candidate
    assert got["Guests may wander in the park."].rejection_reason.endswith("'Glossary'")
    assert got["Guests may wander in the garden."].is_candidate
    cold = got["It may be cold in the hall."]
    assert (cold.deontic_strength, cold.speech_act) == ("none", "assertive")
    assert got["Too short to keep."].rejection_reason == "Too short (4 words < 5)"
    assert got["Failure to pay will lead to trouble."].deontic_strength == "consequence"
    long_one = got[" ".join(["must"] * 151)]
    assert long_one.rejection_reason.startswith("Too long (151 words")
    free = decide(spark, [("It may be cold in the hall.", "")], run_config("no-may-disambig"))
    assert free["It may be cold in the hall."].is_candidate


def plain_headers(text):
    patterns = [
        r"^\s*[\d.]+\s+(.+)$", r"^\s*[IVXLC]+\.\s+(.+)$", r"^\s*[A-Z]\.\s+(.+)$",
        r"^\s*([A-Z][A-Z\s&/]{4,})$",
        r"(?i)^\s*(?:Article|Section|Part|Chapter)\s+\d*[.:]\s*(.+)$",
    ]
    found = []
    for p in patterns:
        for hit in re.finditer(p, text, re.M):
            found.append((hit.start(), hit.group(1).strip().rstrip(":.")))
    return sorted(found, key=lambda x: x[0])


def test_positions_and_sections_equal_plain_python(spark):
    text = (
        "1. Introduction\nThe hall is open.\n\n  2. Requirements:\nPay the fee. Pay the fee.\n"
        "GENERAL RULES\nPay the fee. section 4: Conduct\nSection 4: Conduct\nBe quiet here."
    )
    wanted = ["The hall is open.", "Pay the fee.", "Pay the fee.", "missing one", "Pay the fee.",
              "Be quiet here."]
    pages = spark.createDataFrame(
        [("s", 1, text, wanted)],
        "source STRING, page INT, raw_text STRING, sentences ARRAY<STRING>",
    )
    got = sections.place_sentences(pages).orderBy("ord").collect()
    headers, cursor = plain_headers(text), 0
    for row, sentence in zip(got, wanted):
        at = text.find(sentence, cursor)
        pos = at if at >= 0 else cursor
        cursor = at + len(sentence) if at >= 0 else cursor
        section = ""
        for p, title in headers:
            if p < pos:
                section = title
        assert (row.pos, row.section_context) == (pos, section)
    table = sections.headers(pages).orderBy("pos", "rank").collect()
    assert [(r.pos, r.title) for r in table] == headers


def test_first_object_equals_plain_scan(spark):
    texts = [
        '{"a": 1}', 'x {"a": {"b": 2}} y', '{bad {"a": "}"} z', "none", "{", '{"a": 1} {"b": 2}',
        None, '{x} {"is_rule": true}', '{"a": [1, {"b": "{"}]} tail }', "{}", "x{ }y", '{"a": 1, "a": 2}',
        "{'a': 1}", '{"a": NaN}', '{"a": [-Infinity]} {"b": 1}', '{"a": INF} {"b": "INF"}', '{"a": 01} {"b": 0}',
        '{"a": "x\ny"} {"b": "\\n"}', '{"a": "\\"}"} z', '{"open: {"a": 1}', '{"\\u00e9 {": {"漢": null}}',
        '{"a": 1,} {"b": [1,]} {"c": 3}', '{"a" 1} {"b": {"c": [{}, {"d": "}"}]}}', '{"a": tru} {"a": true}',
        '{"a": 1e5, "b": -0.5}', '{"a": .5} {"a": +1} {a: 1} {"z": "ok"}', '{"a": "b\tc"}', "}{", '{"a": {"b": 1}',
    ]
    r = random.Random(4)
    bits = ['{', '}', '"a"', ':', ' 1', ',', '[', ']', '"', '\\', 'null', ' ', '{"k": {"n": [1, 2]}}', "x"]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]

    def scan(t):
        for i, ch in enumerate(t or ""):
            if ch == "{":
                try:
                    return json.JSONDecoder().raw_decode(t[i:])[0]
                except ValueError:
                    continue
        return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING").repartition(4)
    found = jsontext.with_object(df, "raw", "obj")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert repr(None if r.obj is None else json.loads(r.obj)) == repr(scan(texts[r.i])), texts[r.i]


def similar_names():
    r = random.Random(8)
    parts = ["pay", "fee", "Rent", "attend", "hearing", "vacate", "room", "clean", "é", "漢字", "_", "aab"]
    names = ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(60)]
    names += ["".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(40)]
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz" * 3 + "0123456789") for _ in range(260)) for _ in range(3)]
    names += long + [x[:130] + y[:120] for x in long for y in long] + ["ab" * 120, "x" + "ab" * 110 + "z", "a" * 230]
    return sorted(set(names))


def test_similarity_equals_difflib(spark):
    names = similar_names()
    pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if (i * 7 + j) % 5 == 0]
    df = similarity.with_ratio(spark.createDataFrame(pairs, "a STRING, b STRING").repartition(4), "a", "b", "r")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for x in df.collect():
        assert x.r == difflib.SequenceMatcher(None, x.a, x.b).ratio(), (x.a, x.b)


def test_alike_loses_no_pair(spark):
    names = similar_names()
    want = {
        (a, b): s
        for a in names
        for b in names
        if (s := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.55
    }
    a = spark.createDataFrame([(n,) for n in names], "a STRING")
    got = similarity.alike(a, a.select(F.col("a").alias("b")), "a", "b", 0.55, "s").collect()
    assert len(got) == len(want) and {(x.a, x.b): x.s for x in got} == want


def test_fuzzy_match_equals_difflib(spark):
    vocabulary = ["payFee", "payRent", "attendHearing", "vacateRoom", "vacatesRoom", "clean"]
    names = ["payfees", "payrentnow", "vacateroom1", "hearing", "zzzz", "cleanup", "", "payfees"]
    words = spark.createDataFrame(list(zip(vocabulary, range(6))), "prop STRING, ord LONG")
    lows = spark.createDataFrame([(n,) for n in names], "low STRING")
    lower = {p.lower(): p for p in vocabulary}
    want = {}
    for n in names:
        hit = difflib.get_close_matches(n, list(lower), n=1, cutoff=0.55)
        if hit:
            want[n] = lower[hit[0]]
    assert {r.low: r.fuzzy_prop for r in align.fuzzy(lows, words).collect()} == want


def test_keyword_match_thresholds(spark):
    vocabulary = spark.createDataFrame(
        [("grievance_hearing", 0), ("pay_fee", 1), ("insurance", 2)], "prop STRING, ord LONG"
    )
    rules = spark.createDataFrame(
        [
            ("r1", "The grievance goes to a hearing.", "zzz"),
            ("r2", "Members pay any fee.", "zzz"),
            ("r3", "Buy insurance early.", "zzz"),
        ],
        "rule_id STRING, text STRING, raw_path STRING",
    )
    got = align.keyword_match(rules, vocabulary, Config()).collect()
    # pay + fee share six letters only, below the needed eight
    assert {r.rule_id: r.keyword_prop for r in got} == {
        "r1": "grievance_hearing", "r3": "insurance"
    }


def test_classification_bands(spark):
    rows = spark.createDataFrame(
        [
            ("a", '{"is_rule": true, "rule_type": "odd", "confidence": 0.45}', 0.0),
            ("b", '{"is_rule": true, "rule_type": "permission", "confidence": 0.95}', 0.2),
            ("c", '{"is_rule": false, "confidence": 0.9}', 0.0),
            ("d", "garbage", 0.0),
            ("e", '{"is_rule": true, "rule_type": "obligation", "confidence": 0.45}', 0.15),
        ],
        "id STRING, response_json STRING, confidence_boost DOUBLE",
    )
    out = classify.banded(classify.boosted(classify.repaired(classify.parsed(rows)))).collect()
    got = {r.id: (r.rule_type, round(r.confidence, 6), r.band) for r in out}
    assert got["a"] == ("obligation", 0.4, "uncertain")
    assert got["b"] == ("permission", 1.0, "rule")
    assert got["c"][2] == "dropped" and got["d"][2] == "dropped"
    assert got["e"][1:] == (0.6, "rule")
    reasons = {r.id: r.reasoning for r in out}
    assert reasons["d"] == "parse_error"


def test_control_characters_make_no_headers(spark):
    pages = spark.createDataFrame(
        [("d", "a\u0001b\n1. Fees\nplain\u0001 text\n"), ("e", "\u0001")], "doc STRING, text STRING"
    )
    got = pages.select("doc", F.explode(sections.page_headers(F.col("text"))).alias("h"))
    assert [(r.doc, r.h.pos, r.h.title) for r in got.collect()] == [("d", 4, "Fees")]
