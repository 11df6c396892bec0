"""Shared pieces of the text operators: reading, word tables over Arrow buffers, fingerprint
exchange and connected components.

Text columns stay Arrow buffers inside the tasks: words are found and hashed with whole-array
numpy steps, never one Python object per word. Internal columns start with two underscores; an
input column that is named like a result column is replaced by the result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normspark.operators.keyed import checkpoint, forget

U64 = np.uint64
#: bytes of text one numpy step works on
STEP = 4 << 20
#: groups of documents per shuffle partition, see grouped()
GROUPS_PER_PARTITION = 2

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240917)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps over the tasks of one operator, such as a coder with its cache.

    Workers are shared by all steps of a job, so the next operator's tasks let go of it."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


# --- Arrow columns as arrays ---


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray, kind=pa.binary()) -> pa.Array:
    """The reverse of text_bytes()."""
    array = pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )
    return array.cast(kind)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP):
    """Cut batches so that one piece holds about `most` bytes of text, a single row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def extend(
    docs: DataFrame,
    fn: Callable[[pa.RecordBatch], list],
    fields: dict[str, str],
    keep: Sequence[str] | None = None,
    need: Sequence[str] = ("text",),
    most: int = STEP,
) -> DataFrame:
    """Rows with new columns from fn, piece by piece; keep names the input columns to pass on."""
    new = {name.lower() for name in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    rows = docs.select(*dict.fromkeys([*kept, *need]))
    added = [T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()]
    schema = T.StructType([rows.schema[c] for c in kept] + added)
    names = [*kept, *fields]
    column = need[0]

    def run(batches):
        for piece in slices(batches, column, most):
            made = [piece.column(piece.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*made, *fn(piece)], names=names)

    return rows.mapInArrow(run, schema)


# --- words ---


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all words (runs of bytes that are no ASCII white space) and the first
    word of every row."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts, ends, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of the spans of data, which must be sorted and not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        piece = data[base : int(ends[to - 1])]
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(values[piece] * up[:-1], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        at = to
    return out


FOLDED_VALUE = BYTE_VALUE[FOLD]


def chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every `length` consecutive items, by doubling; the result is shorter by length-1.

    Items of the next row may fall into a window; callers drop windows that leave their row."""
    if len(hashes) < length:
        return np.zeros(0, U64)
    done, out, level, span = 0, None, hashes, 1
    left = length
    while True:
        if left & 1:
            part = level[done : done + len(hashes) - length + 1]
            out = part if out is None else mix(out * U64(0xD6E8FEB86659FD93) + part)
            done += span
        left >>= 1
        if not left:
            return out
        level = mix(level[:-span] * U64(0xA0761D6478BD642F) + level[span:])
        span *= 2


def whole_windows(firsts: np.ndarray, length: int) -> np.ndarray:
    """Which windows of `length` words lie inside one row, given each row's first word."""
    n = int(firsts[-1])
    ok = np.zeros(max(0, n - length + 1), np.int8)
    lengths = np.diff(firsts)
    rows = lengths >= length
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, firsts[:-1][rows], 1)
    np.add.at(mark, firsts[1:][rows] - length + 1, -1)
    return np.cumsum(mark)[: len(ok)] > 0


def covered(flags: np.ndarray, length: int, n: int) -> np.ndarray:
    """Items covered by a flagged window, flags[i] standing for items i to i + length - 1."""
    mark = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    mark[at] += 1
    mark[at + length] -= 1
    return np.cumsum(mark)[:n] > 0


def per_row(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values over rows that begin at firsts (one more than rows)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[firsts])


# --- groups of documents and the exchange of fingerprints ---


def grouped(docs: DataFrame) -> DataFrame:
    """Documents dealt into small groups by a hash of the row: no key of the data takes part, so
    no group is hot. __k tells rows apart; equal rows share it and are interchangeable."""
    parts = partitions(docs.sparkSession)
    groups = parts * GROUPS_PER_PARTITION
    return (
        docs.withColumn("__k", F.xxhash64("text", "doc_id"))
        .withColumn("__g", F.pmod(F.xxhash64("__k", F.lit(7)), F.lit(groups)))
        .repartition(parts, "__g")
    )


def by_row_key(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[("__k", "ascending"), ("doc_id", "ascending")]))


BLOBS = "__block INT, __g LONG, payload BINARY"


def block_bits(spark: SparkSession) -> int:
    """Index blocks are fingerprints with the same leading bits: as many as shuffle partitions or
    more, so that blocks shrink as partitions are added for larger inputs."""
    return max(6, (partitions(spark) - 1).bit_length())


def block_edges(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each block begins among sorted values."""
    return np.searchsorted((values >> U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))


def posted(groups: DataFrame, fingerprints: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Fingerprints of every group, one packed row per group and index block: the distinct values
    in order, then one bit each for values that the group holds more than once."""
    bits = block_bits(groups.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        let_go()
        return pack_fingerprints(fingerprints(rows), rows.column("__g")[0].as_py(), bits)

    return groups.groupBy("__g").applyInArrow(run, BLOBS)


def pack_fingerprints(prints: np.ndarray, group: int, bits: int) -> pa.Table:
    values, counts = np.unique(prints, return_counts=True)
    edges = block_edges(values, bits)
    blocks, payloads = [], []
    for b in np.flatnonzero(np.diff(edges)):
        own = slice(edges[b], edges[b + 1])
        blocks.append(int(b))
        payloads.append(values[own].tobytes() + np.packbits(counts[own] > 1).tobytes())
    return pa.table(
        {
            "__block": pa.array(blocks, pa.int32()),
            "__g": pa.array([group] * len(blocks), pa.int64()),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(payload) * 8 - 7 + 64) // 65
    while n * 8 + (n + 7) // 8 > len(payload):
        n -= 1
    values = np.frombuffer(payload, U64, n)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, offset=n * 8), count=n)
    return values, bits.astype(bool)


def found_elsewhere(blobs: DataFrame) -> DataFrame:
    """For every packed row, the bits of the values that start anywhere else too: in another group
    or again in the same one. One index block meets in one task, all blocks being alike in size;
    a value repeated in every document comes once per group."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for x in rows.column("payload")]
        sizes = [len(v) for v, _ in parts]
        values = np.concatenate([v for v, _ in parts])
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        same = np.zeros(len(values) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        hit = np.empty(len(values), bool)
        hit[order] = same[:-1] | same[1:]
        hit |= np.concatenate([b for _, b in parts])
        ends = np.cumsum(sizes)
        bits = [np.packbits(hit[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table(
            {
                "__block": rows.column("__block"),
                "__g": rows.column("__g"),
                "payload": pa.array(bits, pa.binary()),
            }
        )

    return blobs.groupBy("__block").applyInArrow(run, BLOBS)


def answered(fingerprints: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """A group's answers, one flag for each of its fingerprints in their own order."""
    values, inverse = np.unique(fingerprints, return_inverse=True)
    edges = block_edges(values, bits)
    hit = np.zeros(len(values), bool)
    blocks = answers.column("__block").to_numpy()
    for b, flags in zip(blocks, answers.column("payload"), strict=True):
        n = edges[b + 1] - edges[b]
        hit[edges[b] : edges[b + 1]] = np.unpackbits(
            np.frombuffer(flags.as_buffer(), np.uint8), count=n
        )
    return hit[inverse]


# --- connected components ---


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge (a, b); component is the smallest id reached.

    Alternates two contractions until nothing changes: every larger neighbour is linked to the
    smallest of a node's neighbours, then every smaller one. Edges shrink to stars, so a node
    never gathers its neighbours; only minima are grouped. Each round is checkpointed.
    """
    pair = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    pair = checkpoint(pair.filter("lo <> hi").distinct())
    state = None
    while True:
        both = pair.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            pair.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(
            F.col("m").alias("lo"), F.col("v").alias("hi")
        )
        large = large.filter("lo <> hi").distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi")
        pair = checkpoint(
            small.select(F.col("m").alias("lo"), "hi")
            .unionByName(
                small.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            )
            .distinct()
        )
        digest = pair.agg(
            F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).first()
        if digest == state:
            break
        state = digest
        del both, least, large, small_least, small
        forget(edges.sparkSession)
    nodes = pair.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = pair.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return nodes.unionByName(roots)


def stars(found: DataFrame) -> DataFrame:
    """What components() has found as edges (a, b), which join the same with fewer rows than those it was given."""
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Dealt out by key and checkpointed, so that joins on the key shuffle the other side only."""
    return checkpoint(df.repartition(partitions(df.sparkSession), key))


ROUNDS = 3
#: ids of one key that are compared with each other in a round
BLOCK = 512
#: ids of one key, and items of their sets, that are compared with each other in one part of the key
ASKING = 1000
ASKING_ITEMS = 1 << 21


def linked(
    postings: DataFrame,
    facts: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    sets: DataFrame,
    matches: int,
    percent: int,
    kind=np.uint32,
) -> DataFrame:
    """Components of ids over all true links between ids that share a posting key: (id, component).

    postings has (key, id), facts (id, n, signature of minima of that kind), sets (id, items: sorted 64-bit
    values, packed). First ROUNDS rounds in which every id gives at most one pair (a, b), a < b, see
    nearest(); verified() keeps the true links of these, and large groups of near copies join up. What is
    left are keys with several components. Their ids meet there with their sets, see rest_links(): likely
    pairs are many where a large group lies just below the limit, so they are verified where they are
    found and only links leave the task. Nothing is dropped. State of earlier rounds is let go.
    """
    spark = postings.sparkSession
    found = None
    for turn in range(ROUNDS):
        pairs = nearest(in_several(postings, found), facts, turn, matches, percent, kind)
        fresh = checkpoint(verified(pairs))
        found = checkpoint(components(fresh if found is None else stars(found).unionByName(fresh)))
        del pairs, fresh
        forget(spark)
    # an id has a bounded number of keys
    keys = postings.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    rest = checkpoint(in_several(postings, found))
    more = checkpoint(rest_links(rest, facts.join(keys, "id"), sets, matches, percent, kind))
    return components(stars(found).unionByName(more))


def nearest(
    rows: DataFrame, facts: DataFrame, turn: int, matches: int, percent: int, kind=np.uint32
) -> DataFrame:
    """For every id the pair (a, b) with the id of another component whose signature is most alike.

    An id looks under one of its keys, the first by a hash of the round, so that ids with common
    keys meet; the ids of a key are dealt into blocks of about BLOCK by another such hash.
    """
    order = F.xxhash64("key", F.lit(turn))
    chosen = rows.groupBy("id").agg(F.min_by(F.struct("key", "component"), order).alias("r"))
    chosen = chosen.select("id", "r.key", "r.component")
    parts = chosen.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    parts = parts.select("key", F.ceil(F.col("m") / BLOCK).alias("parts"))
    blocks = chosen.join(parts, "key").join(facts, "id").select(
        "key",
        F.pmod(F.xxhash64("id", F.lit(turn)), "parts").alias("part"),
        "id",
        "component",
        "n",
        "signature",
    )

    def run(group: pa.Table) -> pa.Table:
        ids, own, n, minima = members(group, kind)
        found = []
        for i in range(len(ids)):
            at = comparable(n, own, i, percent)
            alike = (minima[at] == minima[i]).sum(1)
            if len(at) and alike.max() >= matches:
                found.append((ids[i], ids[at[alike.argmax()]]))
        return ordered_pairs(np.array(found, np.int64).reshape(-1, 2).T)

    return blocks.groupBy("key", "part").applyInArrow(run, PAIRS).distinct()


PAIRS = "a LONG, b LONG"


def members(group: pa.Table, kind):
    """Ids, components, sizes and signatures of a group's rows."""
    minima = np.frombuffer(b"".join(group.column("signature").to_pylist()), kind)
    ids, own, n = (group.column(x).to_numpy() for x in ("id", "component", "n"))
    return ids, own, n, minima.reshape(len(ids), -1)


def comparable(n: np.ndarray, own: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Rows of other components whose size allows a link with row i."""
    fits = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
    return np.flatnonzero(fits & (own != own[i]))


def ordered_pairs(pairs: np.ndarray) -> pa.Table:
    return pa.table({"a": pairs.min(0), "b": pairs.max(0)})


def in_several(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with their component, of those keys that still hold several components."""
    if found is None:
        rows = postings.withColumn("component", F.col("id"))
    else:
        rows = postings.join(found, "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
    mixed = rows.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    return rows.join(mixed.filter("lo <> hi").select("key"), "key", "left_semi")


def rest_links(
    rows: DataFrame, facts: DataFrame, sets: DataFrame, matches: int, percent: int, kind=np.uint32
) -> DataFrame:
    """Links (a, b) between different components under the keys of rows, enough to join all that is linked.

    Every id outside a key's largest component is compared with all ids of the key in other components, by
    size, signature and then by the whole sets, the most alike first; what is joined in the task already is
    not compared again. Keys are dealt into x parts of the ids that ask and y parts of all ids, and each of
    the x meets each of the y. A pair is compared under the least key that its ids share; where these share
    several keys, all of them hold different components and are here."""
    sized = rows.join(facts.select("id", "n"), "id")
    counts = sized.groupBy("key", "component").agg(F.count("*").alias("ids"), F.sum("n").alias("items"))
    both = counts.groupBy("key").agg(
        F.max(F.struct("ids", "component", "items")).alias("most"),
        F.sum("ids").alias("ids"),
        F.sum("items").alias("items"),
    )

    def parts(ids, items):
        return F.ceil(F.greatest(ids / F.lit(ASKING), items / F.lit(ASKING_ITEMS))).cast("int")

    keys = both.select(
        "key",
        F.col("most.component").alias("largest"),
        parts(F.col("ids") - F.col("most.ids"), F.col("items") - F.col("most.items")).alias("xs"),
        parts(F.col("ids"), F.col("items")).alias("ys"),
    )
    placed = rows.join(keys, "key").select(
        "key", "id", "component", "xs", "ys", (F.col("component") != F.col("largest")).alias("outside"),
        F.pmod(F.xxhash64("id", F.lit(1)), "xs").cast("int").alias("x"),
        F.pmod(F.xxhash64("id", F.lit(2)), "ys").cast("int").alias("y"),
    )
    asked = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.struct(i.alias("i"), F.col("y").alias("j")))
    asking = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    cells = F.when(F.col("outside"), F.array_union(asked, asking)).otherwise(asked)
    full = placed.join(facts, "id").join(sets, "id").withColumn("cell", F.explode(cells))
    full = full.select(
        "key", "cell.i", "cell.j", "id", "component", "n", "signature", "keys", "items", "outside",
        (F.col("outside") & (F.col("x") == F.col("cell.i"))).alias("asks"),
        (F.col("y") == F.col("cell.j")).alias("asked"),
    )

    def run(group: pa.Table) -> pa.Table:
        ids, own, n, minima = members(group, kind)
        key = group.column("key")[0].as_py()
        asks, asked, outside = (group.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "asked", "outside"))
        # the keys of an id before this one: a pair that shares any of them is compared there
        before = [{x for x in keys if x < key} for keys in group.column("keys").to_pylist()]
        found = [np.zeros((3, 0), np.int64)]
        for i in np.flatnonzero(asks):
            at = comparable(n, own, i, percent)
            # of two ids that ask each other the smaller one does
            at = at[asked[at] & ~(outside[at] & (ids[at] < ids[i]))]
            alike = (minima[at] == minima[i]).sum(1)
            at, alike = at[alike >= matches], alike[alike >= matches]
            free = np.array([before[i].isdisjoint(before[j]) for j in at.tolist()], bool)
            found.append(np.stack([np.full(int(free.sum()), i), at[free], alike[free]]))
        one, other, alike = np.concatenate(found, axis=1)
        one, other = (x[np.argsort(-alike, kind="stable")] for x in (one, other))
        items = group.column("items").combine_chunks()
        sets = {i: np.frombuffer(items[i].as_buffer(), U64) for i in np.unique([one, other]).tolist()}
        linked = joining(one, other, own, lambda i, j: alike_enough(sets[i], sets[j], percent))
        return ordered_pairs(ids[np.array(linked, np.int64).reshape(-1, 2)].T)

    return full.groupBy("key", "i", "j").applyInArrow(run, PAIRS).distinct()


def alike_enough(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sets, given in order, have this Jaccard similarity."""
    both = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def joining(one: np.ndarray, other: np.ndarray, component: np.ndarray, link: Callable[[int, int], bool]) -> list:
    """Of pairs of rows those that are links and join components which no pair before has joined."""
    parent = np.unique(component, return_inverse=True)[1]
    tree = np.arange(len(parent))  # over components

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    found, step = [], 64
    while len(one):
        for i, j in zip(one[:step].tolist(), other[:step].tolist(), strict=True):
            left, right = root(parent[i]), root(parent[j])
            if left != right and link(i, j):
                found.append((i, j))
                tree[max(left, right)] = min(left, right)
        one, other = one[step:], other[step:]
        roots = tree
        while (roots[roots] != roots).any():
            roots = roots[roots]
        tree = roots.copy()
        apart = roots[parent[one]] != roots[parent[other]]
        one, other = one[apart], other[apart]
        step *= 2
    return found
