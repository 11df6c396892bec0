"""Embedding near-dedup by a subspace pigeonhole join.

On unit vectors cosine >= t is squared distance <= 2 - 2t. Vectors are rotated by a fixed random
orthogonal matrix and split into blocks of BLOCK dimensions; every block gets its share of the
squared distance, in proportion to its dimensions. If every block of a pair exceeded its share, the
whole would exceed the budget, so each linked pair is within the share in one block at least. Each
block is range-joined on its own: cells of its first coordinate, twice as wide as the block's
radius, and inside a cell a sweep over the second coordinate, then the block's distance. The union
of all candidates is verified by cosine in double precision on the vectors as given.

Equal vectors of a label are one class before the join; a class of m copies counts m - 1 links for
each copy. Cells with more than CELL_ROWS classes are split: their classes are dealt out as queries,
and all of the cell's classes go along with each part. Candidates are rows (a, b) of class ids,
never lists.

Vectors that are null, empty, zero or hold null or non-finite numbers, and rows without a label,
link with nothing: n_links 0 and a component of their own. Vectors of different lengths never link.
Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.operators.keyed import checkpoint

from . import common as c

COSINE = 0.98
BLOCK = 8
CELL_ROWS = 4000
#: room for rounding in the candidate join, on squared distances
SLACK = 1e-9

POSTED = "label INT, dim INT, block INT, cell INT, home BOOLEAN, id LONG, x BINARY"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def as_matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def budget(cosine: float, dim: int, block: int) -> float:
    """The squared distance a block may have."""
    size = min(BLOCK, dim - block * BLOCK)
    return (2 - 2 * cosine) * size / dim + SLACK


def posted(classes: DataFrame, cosine: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = as_matrix(own.column("embedding"), dim)
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ rotation(int(dim))
                ids, labels = own.column("id").to_numpy(), own.column("label").to_numpy()
                for b in range(-(-int(dim) // BLOCK)):
                    y = np.ascontiguousarray(x[:, b * BLOCK : (b + 1) * BLOCK])
                    radius = np.sqrt(budget(cosine, int(dim), b))
                    cell = np.floor(y[:, 0] / (2 * radius)).astype(np.int64)
                    near = y[:, 0] - cell * 2 * radius <= radius  # of the cell before
                    for home, rows, shift in ((True, np.arange(len(y)), 0), (False, np.flatnonzero(near), 1)):
                        if len(rows):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(labels[rows], pa.int32()),
                                    pa.array([dim] * len(rows), pa.int32()),
                                    pa.array([b] * len(rows), pa.int32()),
                                    pa.array(cell[rows] - shift, pa.int32()),
                                    pa.array([home] * len(rows)),
                                    pa.array(ids[rows], pa.int64()),
                                    pa.array([y[i].tobytes() for i in rows], pa.binary()),
                                ],
                                names=[f.split()[0] for f in POSTED.split(", ")],
                            )

    return classes.select("id", "label", "dim", "embedding").mapInArrow(run, POSTED)


CELL = ["label", "dim", "block", "cell"]


def candidates(posts: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b), a < b, within the budget of a block."""
    sizes = posts.groupBy(*CELL).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    rows = posts.join(sizes, CELL)
    # every row is a query in one part and is looked up in all
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("part", part).withColumn(
        "asks", F.col("home") & (F.pmod(F.xxhash64("id"), "parts") == F.col("part"))
    )

    def run(cell: pa.Table) -> pa.Table:
        dim, block = cell.column("dim")[0].as_py(), cell.column("block")[0].as_py()
        limit = budget(cosine, dim, block)
        size = min(BLOCK, dim - block * BLOCK)
        x = np.frombuffer(b"".join(cell.column("x").to_pylist())).reshape(-1, size)
        sweep = 1 if size > 1 else 0
        order = np.argsort(x[:, sweep], kind="stable")
        x, ids = x[order], cell.column("id").to_numpy()[order]
        home = cell.column("home").to_numpy(zero_copy_only=False)[order]
        asks = np.flatnonzero(cell.column("asks").to_numpy(zero_copy_only=False)[order])
        line, reach = x[:, sweep], np.sqrt(limit)
        low = np.searchsorted(line, line[asks] - reach, "left")
        high = np.searchsorted(line, line[asks] + reach, "right")
        found_a, found_b = [], []
        ends = np.cumsum(high - low)
        at = 0
        while at < len(asks):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + 200_000, "right")))
            count = (high - low)[at:to]
            q = np.repeat(asks[at:to], count)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            r = np.arange(int(count.sum())) + np.repeat(low[at:to] - first, count)
            # two rows of this cell meet once; a row of the next cell meets it as no query
            ok = np.where(home[r], ids[q] < ids[r], True)
            q, r = q[ok], r[ok]
            ok = ((x[q] - x[r]) ** 2).sum(1) <= limit
            found_a.append(ids[q[ok]])
            found_b.append(ids[r[ok]])
            at = to
        a = np.concatenate([np.zeros(0, np.int64), *found_a])
        b = np.concatenate([np.zeros(0, np.int64), *found_b])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy(*CELL, "part").applyInArrow(run, "a LONG, b LONG").distinct()


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    left = classes.select(F.col("id").alias("a"), F.col("embedding").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                y = y.values.to_numpy(zero_copy_only=False).astype(np.float64)
                keep[i] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a LONG, b LONG")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "label", "embedding").withColumn(
        "usable",
        F.col("label").isNotNull()
        & F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.coalesce(
            F.forall(
                "embedding",
                lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
            ),
            F.lit(False),
        )
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)),
    )
    usable = rows.filter("usable")
    classes = checkpoint(
        usable.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
        .filter("id IS NOT NULL")
        .withColumn("dim", F.size("embedding"))
    )
    links = checkpoint(verified(candidates(posted(classes, cosine), cosine), classes, cosine))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("id").alias("b"), "copies")
    partners = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    found = (
        classes.join(partners.withColumnRenamed("a", "id"), "id", "left")
        .join(c.components(links), "id", "left")
        .select(
            "label",
            "embedding",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    joined = usable.join(found, ["label", "embedding"], "left")
    alone = rows.filter("NOT usable")
    return (
        joined.select("vec_id", "n_links", "component_id")
        .unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op3_subspace(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))
