"""Language identification by prediction by partial matching over bytes.

Per language a variable-order context tree holds how often each byte followed the bytes before it.
A byte costs -log2 of its probability in the longest context the language knows; a byte that never
followed that context costs an escape (distinct followers / (occurrences + distinct followers)) and
is then looked up in the next shorter context, down to a uniform order -1. Statistics are frozen
after training, so the code length of a text is a sum over its bytes. Trees are sparse: sorted codes
of (context, byte) with their bits. The distinct codes of a piece of text are found once, and every
language is asked for these only.

Training reads a bounded sample of every language that has a text: about SAMPLE of its distinct
texts, one at least, chosen by a hash of the text and read whole, as are the texts to be predicted.
Each language keeps at most GRAMS (context, byte) pairs of its own: beyond that its own rarest
contexts are left out, whatever the other languages hold. The trees that go to the executors take
about 4 MB per language at most.

Null texts and texts without a letter get `und` and score 0. Without any learned language every
text gets `und`. Ties go to the smaller language name. Rows never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.operators.keyed import checkpoint

from . import common as c

ORDER = 3
SAMPLE = 1500
GRAMS = 1 << 18
NONE = "und"
#: nats of code length that count as one unit of evidence
TEMPERATURE = 8.0

COUNTS = "k INT, gram LONG, n LONG"
#: a gram is its order and, in CODE bits, the bytes of its context and its byte
CODE = 40


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Grams of one order at all bytes that have so many bytes of their row before them."""
    if len(data) <= order:
        return np.zeros(0, np.int64)
    gram = np.zeros(len(data) - order, np.int64)
    for j in range(order + 1):
        gram = gram * 256 + data[j : len(data) - order + j]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return gram[place[order:] >= order] + (order << CODE)


def count_grams(batches):
    """Counts of grams for orders 0 to ORDER, piece by piece."""
    for piece in c.slices(batches):
        lang = piece.column("k").to_numpy()
        for k in np.unique(lang):
            data, offsets = c.text_bytes(piece.column("text").filter(pa.array(lang == k)))
            for order in range(ORDER + 1):
                grams, n = np.unique(grams_of(data, offsets, order), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(n)],
                    names=["k", "gram", "n"],
                )


def context_of(gram):
    """A context is its order and its bytes."""
    return (gram >> CODE << CODE) | ((gram & ((1 << CODE) - 1)) >> 8)


def shorter(gram: np.ndarray) -> np.ndarray:
    """Grams without the first byte of their context; those of order 0 stay."""
    order = np.maximum((gram >> CODE) - 1, 0)
    return (order << CODE) | (gram & ((1 << (8 * (order + 1))) - 1))


class Tree:
    """One language: bits of the grams that occurred, escape bits of their contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, counts = grams[order], counts[order]
        self.contexts, place = np.unique(context_of(self.grams), return_inverse=True)
        seen, distinct = np.bincount(place, counts), np.bincount(place)
        self.bits = -np.log2(counts / (seen + distinct)[place]).astype(np.float32)
        self.escape = -np.log2(distinct / (seen + distinct)).astype(np.float32)

    def cost(self, grams: np.ndarray, contexts: np.ndarray, parent: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of sorted grams that hold all shorter ones; those of order d lie at at[d] to at[d + 1]."""
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[place] == grams
        own = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        escape = np.where(self.contexts[own] == contexts, self.escape[own], np.float32(0))
        bits = np.where(hit, self.bits[place], escape)
        for d in range(ORDER + 1):
            some = slice(at[d], at[d + 1])
            up = bits[parent[some]] if d else np.float32(8)
            bits[some] += np.where(hit[some], np.float32(0), up)
        return bits


class Model:
    """Frozen trees of all languages."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's language with the fewest bits and its share of the evidence."""
        place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)
        code, wide = np.zeros(len(data), np.int64), data.astype(np.int64)
        for d in range(ORDER + 1):
            code[d:] += np.where(place[d:] >= d, wide[: max(len(data) - d, 0)] << (8 * d), 0)
        code += place << CODE
        found = pa.array(code).dictionary_encode()
        own = found.dictionary.to_numpy()
        grams, some = own, own
        for _ in range(ORDER):
            some = np.unique(shorter(some))
            grams = np.concatenate([grams, some])
        grams = np.unique(grams)
        at = np.searchsorted(grams, np.arange(ORDER + 2) << CODE)
        contexts, parent = context_of(grams), np.searchsorted(grams, shorter(grams))
        which, inside = found.indices.to_numpy(), np.searchsorted(grams, own)
        n = len(offsets) - 1
        best, least, total = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        for k, tree in enumerate(self.trees):
            cost = tree.cost(grams, contexts, parent, at)[inside]
            bits = np.diff(np.concatenate([[0.0], np.cumsum(cost[which], dtype=np.float64)])[offsets])
            less = bits < least
            # the shares of the evidence refer to the fewest bits so far
            gap = np.exp(-np.abs(bits - least) * (np.log(2) / TEMPERATURE))
            total = np.where(less, total * gap + 1, total + gap)
            best[less], least[less] = k, bits[less]
        return best, 1 / total


def sampled(rows: DataFrame) -> tuple[list[str], DataFrame | None]:
    """All languages and (k, text): about SAMPLE distinct texts of each, one at least."""
    rows = rows.withColumn("__h", F.xxhash64("text", F.lit("sample")))
    texts = rows.select("lang", "__h").distinct()
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("__h").alias("low")).collect()
    if not sizes:
        return [], None
    sizes.sort(key=lambda r: r["lang"])
    most = [
        (r["lang"], k, max(r["low"], -(1 << 63) + ((1 << 64) * min(SAMPLE, r["n"])) // r["n"] - 1))
        for k, r in enumerate(sizes)
    ]
    most = rows.sparkSession.createDataFrame(most, "lang STRING, k INT, __most LONG")
    chosen = rows.join(F.broadcast(most), "lang").filter("__h <= __most")  # one row per language
    chosen = chosen.groupBy("k", "__h").agg(F.first("text").alias("text"))
    return [r["lang"] for r in sizes], chosen.select("k", "text")


def within_budget(grams: DataFrame) -> DataFrame:
    """Grams of each language's most frequent contexts, at most GRAMS a language.

    A shorter context is never rarer than its extensions, so none loses its parent."""
    count = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count("*").alias("n")).collect()}
    large = [k for k, n in count.items() if n > GRAMS]
    if not large:
        return grams
    low = (1 << CODE) - 1
    bytes_ = F.shiftright(F.col("gram").bitwiseAND(F.lit(low)), 8)
    order = F.shiftleft(F.shiftright("gram", CODE), CODE)
    grams = grams.withColumn("context", order.bitwiseOR(bytes_))
    contexts = grams.groupBy("k", "context").agg(F.sum("n").alias("seen"), F.count("*").alias("grams"))
    contexts = checkpoint(contexts)
    steps = contexts.filter(F.col("k").isin(large)).groupBy("k", "seen").agg(F.sum("grams").alias("grams"))
    least, held = dict.fromkeys(count, 0), dict.fromkeys(count, 0)
    for r in sorted(steps.collect(), key=lambda r: -r["seen"]):  # how often is at most a few thousand values
        held[r["k"]] += r["grams"]
        if held[r["k"]] > GRAMS:
            least[r["k"]] = max(least[r["k"]], r["seen"] + 1)
    least = grams.sparkSession.createDataFrame(list(least.items()), "k INT, least LONG")
    kept = contexts.join(F.broadcast(least), "k").filter("seen >= least")
    return grams.join(kept, ["k", "context"], "left_semi").select("k", "gram", "n")


def train(labelled: DataFrame) -> Model | None:
    """A model of all languages of labelled (text, lang); None without any labelled text."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text")
    langs, sample = sampled(rows)
    if sample is None:
        return None
    grams = checkpoint(sample.mapInArrow(count_grams, COUNTS).groupBy("k", "gram").agg(F.sum("n").alias("n")))
    found = within_budget(grams).toArrow()
    lang, gram, n = (found.column(x).to_numpy() for x in ("k", "gram", "n"))
    order = np.argsort(lang, kind="stable")
    at = np.searchsorted(lang[order], np.arange(len(langs) + 1))
    parts = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return Model(langs, [Tree(gram[x], n[x]) for x in parts])


FIELDS = {"lang_pred": "STRING", "score": "DOUBLE"}


def predict(docs: DataFrame, model: Model | None, keep=None) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded per language

    def run(piece: pa.RecordBatch) -> list[pa.Array]:
        import regex

        c.let_go()
        letter = regex.compile(r"\p{L}").search
        texts = piece.column("text").to_pylist()
        known = shared.value
        langs, scores = [NONE] * len(texts), np.zeros(len(texts))
        if known is not None:
            best, chance = known.best(*c.text_bytes(piece.column("text")))
            for i, t in enumerate(texts):
                if t and letter(t):
                    langs[i], scores[i] = known.langs[best[i]], chance[i]
        return [pa.array(langs, pa.string()), pa.array(scores)]

    return c.extend(docs, run, FIELDS, keep)


def remainder(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op7_ppm_language(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    model = train(docs.filter("NOT held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
