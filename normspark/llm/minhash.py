"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct shingles of five lower-cased words (64-bit hashes; with fewer words
the whole sequence is one shingle). Its signature has COORDINATES minima; a token is a coordinate
with its value. Documents are posted under their tokens and documents that collide in at least
`least` tokens are candidates; matches() derives it from the similarity asked for:

- Tokens that no other set holds cannot collide; they are found by an exchange of packed tokens and
  never become rows. A set with fewer than `least` other tokens links with nothing.
- Prefix: of the m tokens left, the m - least + 1 rarest are posted. Two sets with `least` common
  tokens share one of these, whatever the order; the rarest keep the posting lists short.
- Skip: candidates whose sizes alone rule the similarity out are skipped, and so are those that collide
  too seldom in a wider signature of SKETCH coordinates, a byte of each, which travels with a posting.

What remains is confirmed on the full sets. A pair at the limit collides in `least` of 64
coordinates (40 at 0.85, 36 at 0.80) but for a chance of at most MISS, and in as many of the wider
signature as asked for but for SKETCH_MISS; no candidate below the limit is linked. Limits so low that no number of coordinates meets this are refused.

Equal sets are one class before the join. Classes are joined to components by common.linked(),
which makes no pairs inside a component. Null, empty and blank texts have no set and link with
nothing. Repeated rows belong to the same class; rows that share a doc_id but not their text are told
apart by a hash of both (row_key()). Rows whose doc_id is null take part; a component
of such rows alone has a null component_id and they are kept.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.operators.keyed import checkpoint

from . import common as c

SHINGLE = 5
COORDINATES = 64
PERCENT = 85
#: chance that a pair at the limit is missed
MISS = 5e-6
#: coordinates of the wider signature, and its chance to miss a pair at the limit
SKETCH = 256
SKETCH_MISS = 1e-6

_seeds = np.random.default_rng(20250113).integers(0, 1 << 32, (2, 256), dtype=np.uint32)
FACTORS, MASKS = _seeds[0] | np.uint32(1), _seeds[1]


def matches(percent: int, n: int, miss: float, noise: float = 0.0) -> int:
    """Of n minima, so many that a pair of this similarity has fewer in common with a chance of at most
    miss; unlike minima look alike with a chance of noise."""
    s = percent / 100 + (1 - percent / 100) * noise
    fewer = 0.0
    for m in range(n + 1):
        fewer += comb(n, m) * s**m * (1 - s) ** (n - m)
        if fewer > miss or m == n:
            break
    if not 0 < percent <= 100 or not m:
        raise ValueError(f"{n} minima find pairs of {percent} % with no chance of a miss below {miss}")
    return m


def minima(items: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """n minima for every row of items (64-bit hashes); all rows have items."""
    low = (items >> c.U64(32)).astype(np.uint32) ^ (items & c.U64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(firsts) - 1, n), np.uint32)
    turned = np.empty_like(low)
    for k in range(n):
        np.bitwise_xor(low, MASKS[k], out=turned)
        turned *= FACTORS[k]
        out[:, k] = np.minimum.reduceat(turned, firsts[:-1])
    return out


def shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, repeated ones included, and every row's first."""
    data, offsets = c.text_bytes(column)
    starts, ends, firsts = c.word_bounds(data, offsets)
    words = c.span_hashes(data, starts, ends, c.FOLDED_VALUE)
    n = np.diff(firsts)
    inside = c.whole_windows(firsts, SHINGLE)
    windows = c.chain(words, SHINGLE)[inside]
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(at[-1]), c.U64)
    short = np.zeros(len(out), bool)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short[at[few]] = True
    out[~short] = windows
    for row in few:  # a sequence of its length
        own = words[firsts[row] : firsts[row + 1]]
        out[at[row]] = c.chain(own, len(own))[0] + c.U64(len(own))
    return out, at


def distinct(items: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct items in order, and the rows' first."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((items, row))
    items, row = items[order], row[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (row[1:] != row[:-1])
    return items[new], np.searchsorted(row[new], np.arange(len(firsts)))


SIGNED = {"n_shingles": "LONG", "k": "LONG", "signature": "BINARY", "sketch": "BINARY"}


def signed(piece: pa.RecordBatch) -> list[pa.Array]:
    """Set size, a hash of the set and both signatures; null where there is no set."""
    items, firsts = distinct(*shingles(piece.column("text")))
    n = np.diff(firsts)
    some = np.flatnonzero(n)
    signatures, sketches = [None] * len(n), [None] * len(n)
    if len(some):
        made = minima(items, np.append(firsts[some], len(items)), SKETCH)
        for i, row in zip(some.tolist(), made, strict=True):
            signatures[i] = row[:COORDINATES].tobytes()
            sketches[i] = (row >> np.uint32(8)).astype(np.uint8).tobytes()
    return [
        pa.array(n, pa.int64()), set_key(items, firsts),
        pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary()),
    ]


def tokens(rows: pa.Table) -> np.ndarray:
    values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32)
    place = np.tile(np.arange(COORDINATES, dtype=np.uint64), len(rows))
    return c.mix((place << c.U64(32)) | values.astype(np.uint64))


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(key, id): each class under the prefix of its tokens."""
    parts = c.partitions(classes.sparkSession)
    groups = classes.select(
        "k", "signature", F.pmod(F.xxhash64("k"), F.lit(parts)).alias("__g")
    ).repartition(parts, "__g")
    bits = c.block_bits(classes.sparkSession)
    answers = c.found_elsewhere(c.posted(groups, tokens))

    def shared(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = tokens(rows)
        hit = c.answered(own, answers, bits).reshape(-1, COORDINATES)
        hit &= hit.sum(1, keepdims=True) >= least
        ids = np.repeat(rows.column("k").to_numpy(), COORDINATES)
        flat = hit.ravel()
        return pa.table({"id": ids[flat], "key": own[flat].view(np.int64)})

    rows = groups.groupBy("__g").cogroup(answers.groupBy("__g"))
    rows = checkpoint(rows.applyInArrow(shared, "id LONG, key LONG"))
    spread = rows.groupBy("key").agg(F.count("*").alias("n"))
    own = rows.join(spread, "key").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own")  # at most COORDINATES
    )
    prefix = F.slice("own", 1, F.greatest(F.size("own") - F.lit(least - 1), F.lit(0)))
    return checkpoint(own.select("id", F.explode(prefix.getField("key")).alias("key")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("k").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("items").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), c.U64) for z in (x, y))
                keep[i] = c.alike_enough(x, y, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a LONG, b LONG")


def set_key(items: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """A hash of every row's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(c.mix(items), dtype=c.U64)])
    sums = total[firsts[1:]] - total[firsts[:-1]]
    return pa.array(c.mix(sums ^ c.mix(np.diff(firsts).astype(c.U64))).view(np.int64), pa.int64())


def set_of(piece: pa.RecordBatch) -> list[pa.Array]:
    items, firsts = distinct(*shingles(piece.column("text")))
    return [set_key(items, firsts), c.binaries(items.view(np.uint8), firsts * 8)]


def row_key() -> Column:
    """Tells rows apart; equal rows share it."""
    return F.xxhash64("text", "doc_id")


def marked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, __k (see row_key()), n_shingles, component_id and kept of every row."""
    least = matches(percent, COORDINATES, MISS)
    rows = docs.select("doc_id", "text", row_key().alias("__k"))
    own = checkpoint(c.extend(rows, signed, SIGNED, ["doc_id", "__k"]))
    classes = own.filter("n_shingles > 0").groupBy("k").agg(
        F.min("doc_id").alias("first"),
        F.min("__k").alias("__k"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    )
    posts = postings(classes, least)
    # sets of classes that are posted at all, from one row each
    wanted = posts.select(F.col("id").alias("k")).distinct()
    wanted = c.by_key(classes.drop("signature").join(wanted, "k", "left_semi"), "k")
    texts = rows.join(wanted.select("__k"), "__k", "left_semi")
    keyed = c.extend(texts, set_of, {"k": "LONG", "items": "BINARY"}, [])
    keyed = keyed.join(wanted.select("k"), "k", "left_semi")
    sets = c.by_key(keyed.groupBy("k").agg(F.first("items").alias("items")), "k")

    facts = wanted.select(F.col("k").alias("id"), F.col("n_shingles").alias("n"), F.col("sketch").alias("signature"))
    collisions = matches(percent, SKETCH, SKETCH_MISS, 1 / 256)
    whole = sets.withColumnRenamed("k", "id")
    found = c.linked(posts, facts, lambda pairs: confirmed(pairs, sets, percent), whole, collisions, percent, np.uint8)
    del posts, facts
    c.forget(docs.sparkSession)
    members = found.withColumnRenamed("id", "k")
    first = classes.select("k", "first").join(members, "k")
    first = first.groupBy("component").agg(F.min("first").alias("component_id"))
    grouped = members.join(first, "component").select("k", "component_id")
    of_class = classes.select("k", "first").join(grouped, "k", "left")
    of_class = of_class.select("k", F.coalesce("component_id", "first").alias("component_id"))
    out = own.join(of_class, "k", "left").select(
        "doc_id",
        "__k",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )
    return out.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, keep=None) -> DataFrame:
    """Rows with n_shingles, component_id and kept; keep names the input columns to pass on."""
    new = ["n_shingles", "component_id", "kept"]
    names = [x for x in (docs.columns if keep is None else keep) if x.lower() not in new]
    out = marked(docs, percent)
    if set(names) <= {"doc_id"}:
        return out.select(*names, *new)
    # equal rows have equal facts
    facts = out.groupBy("doc_id", "__k").agg(*(F.first(x).alias(x) for x in new))
    facts = facts.select(F.col("doc_id").alias("__id"), F.col("__k").alias("__f"), *new)
    rows = docs.withColumn("__k", row_key()).select(F.col("doc_id").alias("__own"), "__k", *names)
    same = (F.col("__k") == F.col("__f")) & F.col("__own").eqNullSafe(F.col("__id"))
    return rows.join(facts, same).select(*names, *new)


def op9_minhash_postings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), keep=["doc_id"])


#: all pairs that share a shingle, by their whole sets; for tables whose doc_ids are distinct
ORACLE = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h
    FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS i FROM d)
), n AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ways AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT a, b FROM both_ways JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
    WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
), least_of AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id,
    least(d.doc_id, coalesce(r.b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of AS r ON r.a = d.doc_id
"""
