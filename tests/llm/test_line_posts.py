"""Lines meet by signatures ahead of their texts, and texts are on disk once."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from normspark.llm import lines

LEAST = 27


def signatures(n):
    """Signatures of 40 families: those of one are alike, those of two are not."""
    some = np.random.default_rng(3)
    family = some.integers(0, 40, n)
    signs = some.integers(0, 256, (40, lines.SIGNATURE), dtype=np.uint8)[family]
    for i in range(n):
        signs[i, some.choice(lines.SIGNATURE, 8, replace=False)] = some.integers(0, 256, 8)
    return signs


def with_partner(key, signs):
    alike = (signs[:, None] == signs[None]).sum(2) >= LEAST
    np.fill_diagonal(alike, False)
    return (alike & (key[:, None] == key[None])).any(1)


def posts(spark, key, signs):
    rows = [(int(k), i, 10, s.tobytes()) for i, (k, s) in enumerate(zip(key, signs, strict=True))]
    return spark.createDataFrame(rows, "key LONG, id LONG, bytes INT, signature BINARY")


def test_only_lines_with_a_likely_partner_stay_under_a_key(spark):
    key, signs = np.random.default_rng(4).integers(0, 60, 600), signatures(600)
    kept = {r["id"] for r in lines.alike_posts(posts(spark, key, signs), LEAST).collect()}
    expected = set(np.flatnonzero(with_partner(key, signs)).tolist())
    assert kept == expected
    assert 0 < len(kept) < 400


def test_keys_of_many_batches_are_kept_whole(spark, monkeypatch):
    monkeypatch.setattr(lines, "WIDE", 50)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        key = np.repeat([1, 2, 3, 4], [40, 300, 30, 30])
        signs = signatures(400)
        found = lines.alike_posts(posts(spark, key, signs), LEAST).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    expected = with_partner(key, signs) | (key == 2)
    assert sorted(r["id"] for r in found) == np.flatnonzero(expected).tolist()
    assert {(r["id"], r["key"]) for r in found} == {(i, key[i]) for i in np.flatnonzero(expected).tolist()}


def test_turns_find_the_same_posts(spark, monkeypatch):
    signs = signatures(200)
    bands = np.random.default_rng(6).integers(0, 30, (200, 5))  # 0: a band of its own
    rows = [(i, 10, s.tobytes(), b.tolist()) for i, (s, b) in enumerate(zip(signs, bands, strict=True))]
    classes = spark.createDataFrame(rows, "k LONG, bytes INT, signature BINARY, bands ARRAY<LONG>")
    at_once = {tuple(r) for r in lines.likely_posts(classes, LEAST).collect()}
    monkeypatch.setattr(lines, "TURN_POSTS", 10)
    assert {tuple(r) for r in lines.likely_posts(classes, LEAST).collect()} == at_once
    assert at_once and not any(key == 0 for key, _, _ in at_once)


def test_results_do_not_depend_on_turns(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    some = np.random.default_rng(8)
    base = [" ".join(some.choice(words, 12)) for _ in range(12)]
    near = [x[:-1] + "~" for x in base[:6]]
    rows = [(i, "\n".join(some.choice([*base, *near], 3))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")

    def result():
        return sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.line_dedup(docs).collect())

    at_once = result()
    monkeypatch.setattr(lines, "TURN_BYTES", 300)
    monkeypatch.setattr(lines, "BLOCK", 6)
    assert result() == at_once
    assert sum(n for _, _, n in at_once) >= 100


def test_texts_have_no_second_copy_on_disk(spark):
    def levels():
        return {x: rdd.getStorageLevel() for x, rdd in spark.sparkContext._jsc.getPersistentRDDs().items()}

    before = set(levels())
    docs = spark.createDataFrame([(1, "a line of words\nother"), (2, "a line of words")], "doc_id LONG, text STRING")
    assert lines.line_dedup(docs).count() == 2
    fresh = [level for x, level in levels().items() if x not in before]
    assert fresh and not any(level.useDisk() for level in fresh)
