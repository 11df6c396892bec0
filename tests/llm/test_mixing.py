"""Sources mixed to targets, against highest quotients listed one by one."""

import re
from collections import defaultdict

import pytest

mixing = pytest.importorskip("normspark.llm.mixing")

KIND = "doc_id LONG, text STRING, source STRING, taken STRING, target INT, size STRING"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = (
    [(i, "w " * (i % 40), "big") for i in range(600)]
    + [(i, "two words here \x0b x", "élan") for i in range(600, 640)]
    + [(i, "\n a  b\tc ", "a") for i in range(640, 650)]
    + [(700, None, "a"), (701, "", "void"), (702, " \n", "void"), (None, "x y z", None), (None, "x y z", None)]
    + [(703, "long " * 5000, None), (704, "tie tie", "Z"), (704, "tie tie", "Z")]
)


def targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in ROWS], KIND)


def test_mix(docs):
    got = [r.asDict() for r in mixing.mixed(docs).collect()]
    assert sorted((r["doc_id"] or -1, r["source"] or "", r["size"]) for r in got) == sorted(
        (i or -1, s or "", len(WORD.findall(t or ""))) for i, t, s in ROWS
    )
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    assert want["a"] == 3 * sizes["a"] and want["big"] < 3 * sizes["big"]
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(2, 0.002 * target), source


def test_same_on_any_layout(docs):
    def rows(df):
        return sorted(map(str, mixing.mixed(df).collect()))

    assert rows(docs) == rows(docs.repartition(7).orderBy("text"))


def test_pieces_cover_documents(docs):
    mix = mixing.Mix(docs, block=16, least=1, shard=4000)
    spans = defaultdict(list)
    pieces = mix.pieces().collect()
    for p in pieces:
        spans[p.place, p.shard, p.start, p.size].append((p.first, p.words))
        assert 0 < p.words and 0 <= p.times <= 3
    assert len({p.shard for p in pieces if p.place == "abig"}) == 3
    for (*_, size), own in spans.items():
        at = 0
        for first, words in sorted(own):
            assert first == at
            at += words
        assert at == size
    quotas = mix.quotas().collect()
    blocks = defaultdict(int)
    for place, n in [(q.place, q.blocks) for q in quotas]:
        blocks[place] += n
    assert all(0 <= q.quota <= 3 * q.blocks for q in quotas)


def test_highest_quotients(spark):
    import random

    r = random.Random(3)
    items, want = [], {}
    for g in range(12):
        own = [(g, i, round(r.choice([0.2, 1, 7.5, 300]) * r.random() + 0.01, 3)) for i in range(r.randint(1, 9))]
        own = [(g, i, w, max(1, int(w) + r.randint(0, 2))) for _, i, w in own]
        seats = min(int(sum(x[2] for x in own) + 0.5), sum(x[3] for x in own))
        quotients = sorted((-w / (2 * k + 1), i) for _, i, w, cap in own for k in range(cap))[:seats]
        want |= {(g, i): sum(j == i for _, j in quotients) for _, i, _, _ in own}
        items += [(*x, seats) for x in own]
    df = spark.createDataFrame(items, "g INT, i INT, w DOUBLE, cap LONG, seats LONG")
    got = mixing.apportioned(df, mixing.F.col("g"), ["g", "i"])
    assert {(x.g, x.i): x.quota for x in got.collect()} == want


def test_no_python_in_the_plan(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert mixing.mixed(spark.createDataFrame([], KIND)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a", "", 1, ""), (2, " ", None, "", 1, "")], KIND)
    assert [(r.doc_id, r.target, r.taken) for r in mixing.mixed(nothing).orderBy("doc_id").collect()] == [(1, 0.0, 0), (2, 0.0, 0)]
