"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

Features of a text: its words hashed into 2**BUCKET_BITS buckets (counts, scaled to unit length) and
STATISTICS of its structure, standardised on the training rows; its length is the only metadata
used. The score is the logistic of bias + linear terms + all pairwise interactions of low rank,
computed in time linear in the features by the sum-of-squares identity
    sum over i<j of <v_i, v_j> x_i x_j = 1/2 * sum over f of ((sum v_if x_i)^2 - sum (v_if x_i)^2).

Training takes at most TRAIN_ROWS labelled rows (smallest hashes of doc_id), whose sparse features
are computed on the executors; every document is scored whole. Without labelled rows, or with one
label only, the model falls back to the share of that label (1/2 without rows). Null, empty and
blank texts have no words and are scored from their statistics (all zero). Rows never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .ppm import remainder

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
RANK = 8
TRAIN_ROWS = 8000
EPOCHS = 10
BATCH = 256
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.7

CLASSES = {
    "symbols": b"#*$%&|<>",
    "bars": b"|",
    "bangs": b"!",
    "stops": b".",
    "commas": b",;:",
    "digits": b"0123456789",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "wide": bytes(range(128, 256)),
    "lines": b"\n",
}
STATISTICS = [*CLASSES, "words", "word_length", "distinct", "repeated_triples", "one_letter"]
WIDTH = BUCKETS + len(STATISTICS)


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values and first entries of every row's words, and the rows' statistics."""
    data, offsets = c.text_bytes(column)
    starts, ends, firsts = c.word_bounds(data, offsets)
    rows = len(offsets) - 1
    n_words, n_bytes = np.diff(firsts), np.maximum(np.diff(offsets), 1)
    hashes = c.span_hashes(data, starts, ends, c.FOLDED_VALUE)
    row = np.repeat(np.arange(rows), n_words)
    keys, counts = np.unique((row << BUCKET_BITS) + (hashes >> c.U64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    owner = keys >> BUCKET_BITS
    at = np.searchsorted(owner, np.arange(rows + 1))
    value = np.sqrt(counts.astype(np.float64))
    value /= np.sqrt(np.maximum(np.bincount(owner, value**2, rows), 1e-9))[owner]
    some = np.maximum(n_words, 1)
    stats = []
    for members in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        stats.append(c.per_row(table[data], offsets) / n_bytes)
    stats.append(np.log1p(n_words))
    stats.append(c.per_row(ends - starts, firsts) / some)
    stats.append(np.diff(at) / some)
    triple = c.chain(hashes, 3)
    inside = c.whole_windows(firsts, 3)
    triple = c.mix(triple + c.mix(row[: len(triple)].astype(c.U64)))
    _, inverse, times = np.unique(triple[inside], return_inverse=True, return_counts=True)
    again = np.zeros(len(hashes), bool)
    again[np.flatnonzero(inside)] = times[inverse] > 1
    stats.append(c.per_row(again, firsts) / some)
    stats.append(c.per_row(ends - starts == 1, firsts) / some)
    return keys & (BUCKETS - 1), value, at, np.stack(stats, 1) if rows else np.zeros((0, len(STATISTICS)))


class Machine:
    def __init__(self, bias, weights, factors, mean, scale):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.mean, self.scale = mean, scale

    def joined(self, buckets, values, at, stats):
        """Words and statistics as one sparse row each."""
        rows, k = stats.shape
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4)
        counts = np.diff(at)
        firsts = at + np.arange(rows + 1) * k
        total = int(firsts[-1])
        index, value = np.empty(total, np.int64), np.empty(total)
        word = np.arange(len(buckets)) + np.repeat(np.arange(rows) * k, counts)
        index[word], value[word] = buckets, values
        own = (firsts[:-1] + counts)[:, None] + np.arange(k)
        index[own], value[own] = BUCKETS + np.arange(k), scaled
        return index, value, firsts

    def terms(self, index, value, firsts):
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, firsts[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), firsts[:-1])
        linear = np.add.reduceat(self.weights[index] * value, firsts[:-1])
        return self.bias + linear + 0.5 * ((total**2).sum(1) - squares), total, vx

    def score(self, buckets, values, at, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(stats), self.bias)
        z = self.terms(*self.joined(buckets, values, at, stats))[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(buckets, values, at, stats, label) -> Machine:
    n = len(label)
    if n == 0 or label.min() == label.max():
        return Machine(float(label.mean()) if n else 0.5, None, None, 0, 1)
    random = np.random.default_rng(7)
    machine = Machine(
        float(np.log(label.mean() / (1 - label.mean()))),
        np.zeros(WIDTH),
        random.normal(0, 0.02, (WIDTH, RANK)),
        stats.mean(0),
        stats.std(0) + 1e-6,
    )
    index, value, firsts = machine.joined(buckets, values, at, stats)
    w_sum, v_sum, b_sum = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for a in range(0, n, BATCH):
            own = np.sort(order[a : a + BATCH])
            count = np.diff(firsts)[own]
            begin = np.concatenate([[0], np.cumsum(count)])
            pick = np.arange(begin[-1]) + np.repeat(firsts[own] - begin[:-1], count)
            i, x = index[pick], value[pick]
            z, total, vx = machine.terms(i, x, begin)
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[own]) / len(own)
            each = np.repeat(wrong, count) * x
            grad = np.bincount(i, each, WIDTH) + DECAY * machine.weights
            w_sum += grad**2
            machine.weights -= RATE * grad / np.sqrt(w_sum)
            for f in range(RANK):
                inner = np.repeat(total[:, f], count) - vx[:, f]
                grad = np.bincount(i, each * inner, WIDTH) + DECAY * machine.factors[:, f]
                v_sum[:, f] += grad**2
                machine.factors[:, f] -= RATE * grad / np.sqrt(v_sum[:, f])
            step = wrong.sum()
            b_sum += step**2
            machine.bias -= RATE * step / np.sqrt(b_sum)
    return machine


PACKED = {"buckets": "BINARY", "word_values": "BINARY", "stats": "BINARY"}


def packed(piece: pa.RecordBatch) -> list[pa.Array]:
    buckets, values, at, stats = features(piece.column("text"))
    rows = range(len(stats))
    return [
        pa.array([buckets[at[i] : at[i + 1]].astype(np.uint16).tobytes() for i in rows], pa.binary()),
        pa.array([values[at[i] : at[i + 1]].astype(np.float32).tobytes() for i in rows], pa.binary()),
        pa.array([stats[i].tobytes() for i in rows], pa.binary()),
    ]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """A machine from labelled documents: labels has (doc_id, quality), at most `most` are used."""
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = c.extend(rows, packed, PACKED, ["doc_id", "quality"]).toArrow().sort_by("doc_id")
    buckets = [np.frombuffer(x.as_py(), np.uint16) for x in found.column("buckets")]
    values = [np.frombuffer(x.as_py(), np.float32) for x in found.column("word_values")]
    stats = [np.frombuffer(x.as_py()) for x in found.column("stats")]
    at = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int64)
    label = found.column("quality").to_numpy().astype(np.float64)
    if not len(label):
        return fit(None, None, at, np.zeros((0, len(STATISTICS))), label)
    return fit(
        np.concatenate(buckets).astype(np.int64),
        np.concatenate(values).astype(np.float64),
        at,
        np.stack(stats),
        label,
    )


FIELDS = {"score": "DOUBLE", "predicted": "INT"}


def classify(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, keep=None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # WIDTH * (RANK + 1) numbers

    def run(piece: pa.RecordBatch) -> list[pa.Array]:
        score = shared.value.score(*features(piece.column("text")))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return c.extend(docs, run, FIELDS, keep)


def op6_factorisation(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    docs = c.table(spark, sf_dir, "documents").withColumn("held_out", held)
    labels = c.table(spark, sf_dir, "labels").filter(~held)
    return classify(docs, train(docs, labels), keep=["doc_id", "held_out"])
