"""Similarity limits other than the queries' own, and the pipeline's near dedup."""

import math
import random

import pytest

pytest.importorskip("normspark.llm")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from normspark.llm import lines, minhash  # noqa: E402


def pair(shared, own, seed, make=lambda r: f"w{r.randrange(10**6)}"):
    """Two sequences with a common start, then items of their own."""
    r = random.Random(seed)
    start = [make(r) for _ in range(shared)]
    return [start + [make(r) for _ in range(own)] for _ in range(2)]


def similarity(x, y, size):
    x, y = ({tuple(t[j : j + size]) for j in range(len(t) - size + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_numbers_follow_the_limit():
    assert (minhash.matches(85, 64, minhash.MISS), lines.bands_for(80)) == (40, (19, 5))
    assert minhash.matches(80, lines.SIGNATURE, lines.SIGNATURE_MISS, 1 / 256) == 27
    assert minhash.matches(100, 64, minhash.MISS) == 64
    for percent in range(20, 100):
        s, least = percent / 100, minhash.matches(percent, 64, minhash.MISS)
        missed = [sum(math.comb(64, i) * s**i * (1 - s) ** (64 - i) for i in range(m)) for m in (least, least + 1)]
        assert missed[0] <= minhash.MISS < missed[1]
        bands, rows = lines.bands_for(percent)
        assert (1 - s**rows) ** bands <= lines.MISS
    for percent in (0, 1, 101):
        with pytest.raises(ValueError):
            minhash.matches(percent, 64, minhash.MISS)
        with pytest.raises(ValueError):
            lines.bands_for(percent)


def test_low_limits_find_their_pairs(spark):
    pairs = [pair(80, 26, seed) for seed in range(40)]
    assert all(0.55 < similarity(x, y, 5) < 0.62 for x, y in pairs)
    texts = [" ".join(t) for p in pairs for t in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 50, keep=["doc_id"]).collect()}
    assert found == {i: i // 2 * 2 for i in range(len(texts))}
    pairs = [pair(80, 26, seed, lambda r: r.choice("abcdefghijklmnopqrstuvwxyz")) for seed in range(300)]
    assert all(similarity(x, y, 5) > 0.5 for x, y in pairs)
    docs = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(t for p in pairs for t in p)], docs.schema)
    gone = {r.doc_id for r in lines.line_dedup(docs, 50).filter("n_removed > 0").collect()}
    assert gone == set(range(1, 600, 2))


def test_near_dedup_of_the_pipeline(spark):
    close, apart = pair(200, 20, 1), pair(200, 30, 2)
    assert 0.81 < similarity(*close, 5) < 0.85 and similarity(*apart, 5) < 0.79
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate([*close, *apart])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    kept = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]
