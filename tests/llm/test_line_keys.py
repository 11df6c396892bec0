import random
from itertools import combinations

import pytest

pytest.importorskip("public_tokenizers")

from normspark.llm import common as c
from normspark.llm import lines


def kept_keys(spark, keys):
    rows = [(k, i, 10) for k, ids in keys.items() for i in ids]
    thin = spark.createDataFrame(rows, "key LONG, id LONG, bytes INT")
    return {r["id"]: {x["key"] for x in r["keys"]} for r in lines.meeting_keys(thin).collect()}


def test_keys_with_the_same_lines_or_fewer_are_left_out(spark):
    keys = {11: [1, 2], 12: [1, 2], 13: [1, 2, 3], 14: [4], 15: [5, 6], 16: [6, 7], 17: [5, 7], 18: [7, 6]}
    kept = kept_keys(spark, keys)
    assert {i: kept[i] for i in (1, 2, 3)} == {1: {13}, 2: {13}, 3: {13}}
    assert 4 not in kept
    assert kept == {1: {13}, 2: {13}, 3: {13}, 5: {15, 17}, 6: {15, 16}, 7: {16, 17}}


def test_every_pair_still_meets(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 6)  # some keys have several parts
    some = random.Random(5)
    keys = {k: some.sample(range(40), some.choice((1, 2, 2, 3, 5, 9, 14))) for k in range(1, 90)}
    kept = kept_keys(spark, keys)
    pairs = {p for ids in keys.values() for p in combinations(sorted(ids), 2)}
    assert pairs
    assert all(kept[a] & kept[b] for a, b in pairs)
    assert sum(map(len, kept.values())) < sum(map(len, keys.values()))


def test_lines_are_stored_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "a line of words\nother"), (2, "a line of words")], "doc_id LONG, text STRING")
    found = lines.recurring(c.grouped(docs), 80)
    assert "text" not in found.columns
    assert [r["bytes"] for r in found.collect()] == [15, 15]


def test_a_worker_lets_go_of_another_operators_cache():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert [c.kept(("a",), make("a")) for _ in range(2)] == ["a", "a"]
    assert c.kept(("b",), make("b")) == "b"
    assert c.kept(("a",), make("a")) == "a"
    assert made == ["a", "b", "a"]
    c.let_go()
    assert c._kept == {}
