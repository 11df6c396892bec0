"""Centroid clustering by a LAESA pivot table.

Vectors become integers and their distances to a few fixed pivots are computed once and stored beside
them. In every round a pivot p bounds the distance of a vector x to a centroid c from below by
|d(x, p) - d(c, p)|; a centroid whose best bound is above the distance already found can't be the
nearest, and only the others get an exact distance, in integers. Rounds send the centroids out (K vectors of
integers) and get integer sums and counts back, summed inside each task first; a round's result is the
same on any layout of the data.

Pivots are chosen among the first centroids, each the farthest from those before it. Bounds are
floating point and are lowered by more than their rounding error, so they never drop a nearest
centroid; ties go to the smaller number, exactly.

Skew: vectors are never grouped by cluster: each task sends one row per cluster, so a cluster with a third
of all vectors, or one vector repeated a million times, is no hot key. Labels play no part. The table is
written once into the shared folder; a lost executor repeats its own part of a round.

Vectors that are null, of another length, or hold a null or non-finite component are left out, and so are
vectors with a component whose integer is beyond +-2**26, as squared distances would leave 64
bits. Repeated rows count as often as they occur; rows with an equal hash (a repeated vec_id) are ordered by
their components, and rows without vec_id never start as a centroid. With fewer vectors than K there
are as many centroids as vectors; without any the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.operators.keyed import stored

from . import common

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 6
SEED = 1
WIDEST = 1 << 26


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): components as floor(scale * x)."""
    as_double = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < WIDEST))
    # a NaN is above every number, so it isn't usable
    rows = vectors.filter((F.size("embedding") == dimensions) & usable)
    return rows.select("vec_id", as_double.cast("array<int>").alias("x"))


def first_centroids(kept: DataFrame, n: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    named = kept.filter("vec_id IS NOT NULL")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = named.orderBy(digest, "x").limit(n).select("x").collect()
    return np.array([r.x for r in rows], np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y, a vector or one row for each."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def spread_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n rows, the first one and then always the farthest from those chosen."""
    chosen, near = [0], squared(centroids, centroids[0])
    while len(chosen) < min(n, len(centroids)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, squared(centroids, centroids[chosen[-1]]))
    return centroids[chosen]


def components(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """kept with the squared distance to every pivot."""

    def run(batches):
        for batch in batches:
            x = components(batch.column(1))
            table = np.stack([squared(x, p) for p in pivots], axis=1)
            ends = pa.array(np.arange(0, table.size + 1, len(pivots)), pa.int32())
            far = pa.ListArray.from_arrays(ends, pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, far], names=["vec_id", "x", "far"])

    return kept.mapInArrow(run, "vec_id LONG, x ARRAY<INT>, far ARRAY<LONG>")


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Number and squared distance of each row's nearest centroid, and how many distances were taken."""
    n, k = len(x), len(centroids)
    own = np.sqrt(far.astype(np.float64))
    to_pivots = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((n, k))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(own[:, j, None] - to_pivots[None, :, j]), out=bound)
    # roots are off by 2**-52 of their size, which is below 2**31
    bound = np.maximum(bound - 1e-5, 0) ** 2 * (1 - 1e-12)
    start = np.argmin(bound, axis=1)
    best, distance = start.copy(), squared(x, centroids[start])
    taken = n
    for c in range(k):
        rows = np.flatnonzero((bound[:, c] <= distance) & (start != c))
        if not len(rows):
            continue
        taken += len(rows)
        d = squared(x[rows], centroids[c])
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best, distance, taken


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return components(batch.column(batch.schema.get_field_index("x"))), components(batch.column(batch.schema.get_field_index("far")))


def next_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""

    def run(batches):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x, far = matrices(batch)
            cluster, _, _ = nearest(x, far, centroids, pivots)
            for c in range(len(centroids)):
                own = cluster == c
                sums[c] += x[own].sum(axis=0)
                counts[c] += own.sum()
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_pydict(
                {"cluster": pa.array(seen, pa.int32()), "n": counts[seen], "sums": pa.array(list(sums[seen]), pa.list_(pa.int64()))}
            )

    parts = table.select("x", "far").mapInArrow(run, "cluster INT, n LONG, sums ARRAY<LONG>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at")
    total = rows.agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = centroids.copy()
    for r in total.collect():  # a row per centroid and component
        out[r.cluster, r["at"]] = int(r.value) // r.n
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact): n_exact centroids' distances were computed for the batch,
    per row on average, the others were ruled out by the pivots."""

    def run(batches):
        for batch in batches:
            x, far = matrices(batch)
            cluster, distance, taken = nearest(x, far, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(np.full(len(x), taken / max(1, len(x))))],
                names=["vec_id", "cluster", "distance", "n_exact"],
            )

    return table.mapInArrow(run, "vec_id LONG, cluster INT, distance LONG, n_exact DOUBLE")


def clustered(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, n_pivots: int = PIVOTS, seed: int = SEED):
    """Assignment of all usable vectors and the centroids, after `rounds` rounds."""
    kept = kept_vectors(vectors)
    centroids = first_centroids(kept, n, seed)
    if not len(centroids):
        nothing = kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.withColumn("n_exact", F.lit(0.0)), centroids
    pivots = spread_pivots(centroids, n_pivots)
    table = stored(pivot_table(kept, pivots))
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, pivots)
    return stored(assigned(table, centroids, pivots)), centroids


def op13_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(common.table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster INT, centroid_sha256 STRING")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).alias("inertia")
    # a row per centroid
    facts = sums.select("cluster", "cluster_inertia", total).join(F.broadcast(names), "cluster")
    return rows.drop("n_exact").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round(i: int) -> str:
    """DuckDB text of one assignment and the centroids after it."""
    return f"""
a{i} AS (
    SELECT k, vec_id, x, c, d FROM (
        SELECT v.k, v.vec_id, v.x, c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda j: (v.x[j] - m.x[j]) * (v.x[j] - m.x[j])))::BIGINT AS d
        FROM v CROSS JOIN c{i} AS m
    ) QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, c) = 1
), p{i} AS (
    SELECT c, j, floor_div FROM (
        SELECT c, j, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
        FROM (SELECT c, unnest(x) AS y, unnest(range({DIMENSIONS})) AS j FROM a{i}) GROUP BY c, j
    )
), c{i + 1} AS (
    SELECT c{i}.c, coalesce(n.x, c{i}.x) AS x
    FROM c{i} LEFT JOIN (SELECT c, list(floor_div::BIGINT ORDER BY j) AS x FROM p{i} GROUP BY c) AS n USING (c)
)"""


ORACLE = f"""
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) = {DIMENSIONS}
        AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y) AND abs(y::DOUBLE) * {SCALE} < {WIDEST})) = {DIMENSIONS}
), v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(x, lambda y: y::BIGINT) AS x FROM e
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x)::INTEGER - 1 AS c, x FROM v WHERE vec_id IS NOT NULL
    QUALIFY c < {CENTROIDS}
), {", ".join(_round(i).strip() for i in range(ROUNDS + 1))}
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} AS m USING (c)
"""
