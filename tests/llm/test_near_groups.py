"""Large groups of near copies, many of them just below the limit."""

import random

import pytest

pytest.importorskip("normspark.llm")
pytest.importorskip("public_tokenizers")

from normspark.llm import common, minhash  # noqa: E402

LIMIT = 85


def shingles(text):
    w = text.split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def near_copies(number, most, seed):
    """Texts of one base, up to `most` of its 200 words replaced in each."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(number):
        own = list(base)
        for at in r.sample(range(200), r.randint(most // 2, most)):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


def brute(texts):
    sets = [shingles(t) for t in texts]
    of = list(range(len(texts)))
    links = 0
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= LIMIT * len(sets[a] | sets[b]):
                links += 1
                lo, hi = sorted((of[a], of[b]))
                of = [lo if x == hi else x for x in of]
    return of, links


@pytest.mark.parametrize("asking", [1000, 7])
def test_only_links_leave_a_group_of_near_copies(spark, monkeypatch, asking):
    texts = near_copies(90, 6, 1) + near_copies(60, 4, 2)
    want, links = brute(texts)
    assert 10 < len(set(want)) < len(texts) - 10 and links > 20
    monkeypatch.setattr(common, "ASKING", asking, raising=False)
    seen = []

    def confirmed(pairs, sets, percent, whole=minhash.confirmed):
        seen.append(pairs.count())
        return whole(pairs, sets, percent)

    monkeypatch.setattr(minhash, "confirmed", confirmed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, LIMIT, keep=["doc_id"]).collect()}
    assert [found[i] for i in range(len(texts))] == want
    # every id gives a pair a round at most
    assert sum(seen) <= common.ROUNDS * len(texts)
