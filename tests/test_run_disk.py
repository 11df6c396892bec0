"""What the comparison of run settings writes down."""

from normspark.config import run_config
from normspark.operators import classify, prefilter
from normspark.plans import pipeline
from testbed import tables as t

WORDS = ("Students must pay fee %d now.", "Guests may wander in park %d.", "It may be cold in hall %d.", "Room %d is old.")


def test_sentences_are_stored_once(spark, monkeypatch):
    rows = [("a", 1, 0, i, WORDS[i % 4] % i) for i in range(200)]
    sentences = spark.createDataFrame(rows, "source STRING, page LONG, item_pos INT, sent_pos INT, text STRING")
    rules = spark.createDataFrame([("r1", "pay", "obligation")], "rule_id STRING, text STRING, rule_type STRING")
    store = spark.createDataFrame([], "cache_key STRING, attempt INT, response_json STRING")
    written = []

    def noted(df):
        out = real(df)
        written.append((out.columns, out.count()))
        return out

    real = pipeline.stored
    monkeypatch.setattr(pipeline, "stored", noted)
    runs = ("baseline", "no-prefilter", "no-reclassify", "no-may-disambig")
    got = pipeline.run_counts(sentences, t.classification_store, t.second_store, lambda _: rules, store, store, runs)
    got = {r.run: r for r in got.collect()}
    for name in runs:
        c = run_config(name)
        requests = classify.requests(prefilter.candidates(sentences, c), c)
        answered = classify.classified(requests, t.classification_store(requests))
        final = classify.second_opinion(answered, t.second_store(answered), c)
        assert got[name].candidates_prefiltered == requests.count()
        assert got[name].rules_classified == final.count()
        assert (got[name].formulas_ok, got[name].formulas_failed, got[name].shapes_total) == (0, 1, 0)
    assert sum(n == 200 for _, n in written) == 1
    assert not any("response_json" in names and "text" in names and "band" in names for names, _ in written)
