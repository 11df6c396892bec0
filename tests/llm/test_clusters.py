"""Clusters by the pivot table against plain rounds."""

import hashlib
import random

import pytest

clusters = pytest.importorskip("normspark.llm.clusters")

import math  # noqa: E402

import numpy as np  # noqa: E402

KIND = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, cluster STRING, distance STRING"


def rows():
    r = random.Random(2)
    heads = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = [(i, [x + r.gauss(0, 0.3) for x in r.choice(heads)]) for i in range(400)]
    out += [(1000 + i, out[7][1]) for i in range(150)] + [(5, [0.5] * 64), (5, [0.25] * 64), (None, out[9][1])]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] + [0.0] * 63, [3e9] + [0.0] * 63]
    return out + [(2000 + i, x) for i, x in enumerate(bad)] + [(3000, [-(2.0**19)] * 64), (3001, [0.0] * 64)]


ROWS = rows()


def brute(rows, k=16, rounds=3):
    kept = []
    for i, x in rows:
        if x is None or len(x) != 64 or any(y is None or not math.isfinite(y) or abs(y) * 64 >= 2**26 for y in x):
            continue
        kept.append((i, [math.floor(64 * float(np.float32(y))) for y in x]))

    def order(row):
        return hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1]

    centroids = [x for _, x in sorted((r for r in kept if r[0] is not None), key=order)[:k]]

    def assign():
        out = []
        for i, x in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(centroids))
            out.append((i, c, d))
        return out

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for (_, x), (_, c, _) in zip(kept, assign(), strict=True):
            own[c].append(x)
        centroids = [[sum(col) // len(xs) for col in zip(*xs, strict=True)] if xs else m for xs, m in zip(own, centroids, strict=True)]
    return sorted(assign(), key=str), centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash", "clash") for i, x in rows], KIND).repartition(3)


@pytest.mark.parametrize("pivots", [1, 6, 16])
def test_clusters(spark, pivots):
    got, centroids = clusters.clustered(frame(spark, ROWS), n_pivots=pivots)
    want, want_centroids = brute(ROWS)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert centroids.tolist() == want_centroids


def test_pivots_rule_out_centroids(spark):
    got, _ = clusters.clustered(frame(spark, ROWS))
    assert max(r.n_exact for r in got.select("n_exact").distinct().collect()) < 12


def test_query(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centroids = brute(ROWS)
    for r in clusters.op13_laesa_clusters(spark, str(tmp_path)).collect():
        own = [d for _, c, d in want if c == r.cluster]
        assert (r.cluster_inertia, r.inertia) == (sum(own), sum(d for _, _, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_and_none(spark):
    few = ROWS[:3] + ROWS[:2]
    got, centroids = clusters.clustered(frame(spark, few))
    want, want_centroids = brute(few)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert centroids.tolist() == want_centroids
    for none in (ROWS[:0], [(1, None), (2, [1.0])]):
        got, centroids = clusters.clustered(frame(spark, none))
        assert got.count() == 0 and len(centroids) == 0
