"""Fuzzy line dedup by MinHash.

Lines are the parts of a text between line feeds; lines without a word are left alone. A line's set
is its distinct shingles of SHINGLE characters (the whole line, if it is shorter), with A-Z folded.
Signatures are cut into bands of several minima (bands_for(): 19 of 5 at 0.8). Two lines at the limit
miss each other with a chance of at most MISS; two of similarity 0.3 share a band of these 19 with one
of 5 %, so that few unlike lines become candidates. Lines that share a band with another line are verified by
exact Jaccard similarity of their sets, links are joined to components, and the first line of a
component (by doc_id, then place) stays; all others are removed from their texts.

Equal lines are one class: an exchange of packed line hashes names one of them that stands for all,
and only this one takes part in the banding, so a line that stands in every document is one row per
document in a plain minimum and one class in the join. Band keys travel packed, 8 bytes each; only
lines that have copies or share a band with a different line become rows, and only the latter with
bands (0 for a band of its own). Unlike lines that share a band by chance grow with the square of the lines, so
lines first meet under their keys with their signatures only, and a line stays under a key where another one's is
alike enough for a link. Texts go to the places where lines are compared and nowhere else: these are found on rows without texts.
Of keys that hold the same lines, or lines that one other key holds, one is enough. Signatures stay as one byte of each minimum. Pairs inside a component are not made (common.linked()).

Null and blank texts have no lines. A text all of whose lines are removed becomes empty and its
row stays. Equal rows are different documents: the lines of all but one of them go.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normspark.operators.keyed import checkpoint, stored

from . import common as c
from .minhash import FACTORS, distinct, matches, minima

SHINGLE = 5
#: chance that two lines at the limit share no band
MISS = 5.5e-4
#: minima of a line, as long as bands of several of them can be cut from so few
MINIMA = 96
#: minima of which a byte stays with a line after the banding
SIGNATURE = 48
#: chance that a pair at the limit has too few of these in common to get its sets compared
SIGNATURE_MISS = 1e-4
PERCENT = 80
STRETCH = 1 << 17
#: lines and bytes of one key that are compared with each other in one part
BLOCK = 512
BLOCK_BYTES = 1 << 20
#: lines of one key up to which their signatures are compared ahead of their texts; larger keys go on whole
WIDE = 4096
#: places are worked off in turns, so that texts of one turn only are on disk: bytes of a turn, as a share of
#: all lines with bands, and at least so many; for signatures one post a line, and at least so many posts
TURN_SHARE = 0.25
TURN_BYTES = 32 << 20
TURN_POSTS = 1 << 19
NEW = {"n_lines": "LONG", "n_removed": "LONG"}


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima in each: bands as narrow as needed for MISS, as wide as MINIMA allow."""
    if not 0 < percent <= 100:
        raise ValueError(f"no similarity: {percent} %")
    for rows in range(MINIMA, 0, -1):
        shared = (percent / 100) ** rows
        bands = 1 if shared == 1 else math.ceil(math.log(MISS) / math.log1p(-shared))
        if bands * rows <= (MINIMA if rows > 1 else len(FACTORS)):
            return bands, rows
    raise ValueError(f"{len(FACTORS)} minima find pairs of {percent} % with no chance of a miss below {MISS}")


def line_table(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all lines with a word, and every row's first such line."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    following = np.append(starts[1:], len(data))
    ends = following - (data[following - 1] == 10)
    inside = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~c.SPACE[data], out=inside[1:])
    real = inside[ends] > inside[starts]
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


def line_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Character shingles of every line (64-bit hashes, repeated ones included), each line's first.

    Characters are hashed from their bytes; a shingle is SHINGLE characters of one line."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    values = c.FOLDED_VALUE[data[chars]]
    wide = np.flatnonzero(data[chars] >= 0xC0)
    end = np.append(chars, len(data))[wide + 1]
    for k in range(1, 4):  # the further bytes of a character
        wide, end = wide[chars[wide] + k < end], end[chars[wide] + k < end]
        values[wide] = c.mix(values[wide] + c.BYTE_VALUE[data[chars[wide] + k]])
    first, last = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    n = last - first
    counts = np.maximum(n - SHINGLE + 1, 1)
    at = np.concatenate([[0], np.cumsum(counts)])
    windows = c.chain(values, SHINGLE)
    pick = np.arange(int(at[-1])) + np.repeat(first - at[:-1], counts)
    short = np.flatnonzero(n < SHINGLE)
    pick[at[short]] = 0
    out = windows[pick] if len(windows) else np.zeros(len(pick), c.U64)
    for i in short:
        own = values[first[i] : last[i]]
        out[at[i]] = c.chain(own, len(own))[0] + c.U64(len(own))
    return out, at


def signatures(data, starts, ends, n: int) -> np.ndarray:
    return minima(*line_sets(data, starts, ends), n)


def band_keys(made: np.ndarray, bands: int, rows: int) -> np.ndarray:
    made = made.astype(np.uint64)
    out = np.empty((len(made), bands), c.U64)
    for b in range(bands):
        key = np.full(len(made), b + 1, c.U64)
        for r in range(rows):
            key = c.mix(key * c.U64(0x9E3779B97F4A7C15) + made[:, b * rows + r])
        out[:, b] = key
    return out


def banded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int):
    """Signatures and band keys of lines."""
    keys = np.empty((len(starts), bands), c.U64)
    signs = np.empty((len(starts), SIGNATURE), np.uint8)
    at = 0
    while at < len(starts):  # a stretch of text at a time whose shingles stay in the CPU's cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, "right")))
        base, stop = int(starts[at]), int(ends[to - 1])
        made = signatures(data[base:stop], starts[at:to] - base, ends[at:to] - base, max(bands * rows, SIGNATURE))
        signs[at:to] = made[:, :SIGNATURE] >> 8
        keys[at:to] = band_keys(made, bands, rows)
        at = to
    return signs, keys


def lines_of(rows: pa.Table):
    """Bytes of the texts, their lines' starts, ends and hashes, every row's first line."""
    data, offsets = c.text_bytes(rows.column("text"))
    starts, ends, firsts = line_table(data, offsets)
    return data, starts, ends, firsts, c.span_hashes(data, starts, ends)


def first_holders(blobs: DataFrame) -> DataFrame:
    """For every packed row of line hashes, the bits of those that stand anywhere else too, then
    the bits of those that no group of a smaller number holds."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [c.unpacked(x.as_py()) for x in rows.column("payload")]
        sizes = np.array([len(v) for v, _ in parts])
        values = np.concatenate([v for v, _ in parts])
        order = np.lexsort((np.repeat(rows.column("__g").to_numpy(), sizes), values))
        same = np.zeros(len(values) + 1, bool)
        same[1:-1] = values[order][1:] == values[order][:-1]
        again, first = np.empty((2, len(values)), bool)
        again[order] = same[:-1] | same[1:]
        first[order] = ~same[:-1]
        again |= np.concatenate([b for _, b in parts])
        bits = [
            np.packbits(again[e - n : e]).tobytes() + np.packbits(first[e - n : e]).tobytes()
            for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)
        ]
        return pa.table(
            {
                "__block": rows.column("__block"),
                "__g": rows.column("__g"),
                "payload": pa.array(bits, pa.binary()),
            }
        )

    return blobs.groupBy("__block").applyInArrow(run, c.BLOBS)


def leaders(hashes: np.ndarray, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have copies, and which stand for their copies: one line of all equal ones."""
    values, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    edges = c.block_edges(values, bits)
    again, first = np.zeros((2, len(values)), bool)
    blocks = answers.column("__block").to_numpy()
    for b, flags in zip(blocks, answers.column("payload"), strict=True):
        own, n = slice(edges[b], edges[b + 1]), edges[b + 1] - edges[b]
        flags = np.frombuffer(flags.as_buffer(), np.uint8)
        again[own] = np.unpackbits(flags, count=n)
        first[own] = np.unpackbits(flags[(n + 7) // 8 :], count=n)
    leads = np.zeros(len(hashes), bool)
    leads[index[first]] = True
    return again[inverse], leads


RECURRING = "doc_id LONG, __g LONG, row INT, line INT, k LONG, bytes INT, signature BINARY, bands ARRAY<LONG>"


def recurring(groups: DataFrame, percent: int) -> DataFrame:
    """Lines that have copies or share a band with another line.

    One of all equal lines stands for them: only it is posted under its bands, and it alone has
    signature and bands, if a different line shares one."""
    bits = c.block_bits(groups.sparkSession)
    shape = bands_for(percent)
    heads = c.posted(groups, lambda t: lines_of(t)[-1])
    heads = checkpoint(first_holders(heads))

    def post(rows: pa.Table, heads: pa.Table) -> pa.Table:
        data, starts, ends, _, hashes = lines_of(c.by_row_key(rows))
        leads = leaders(hashes, heads, bits)[1]
        keys = banded(data, starts[leads], ends[leads], *shape)[1]
        return c.pack_fingerprints(keys.ravel(), rows.column("__g")[0].as_py(), bits)

    posts = groups.groupBy("__g").cogroup(heads.groupBy("__g")).applyInArrow(post, c.BLOBS)
    replies = heads.withColumn("__kind", F.lit(0)).unionByName(
        c.found_elsewhere(posts).withColumn("__kind", F.lit(1))
    )

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        rows = c.by_row_key(rows)
        kind = replies.column("__kind").to_numpy()
        data, starts, ends, firsts, hashes = lines_of(rows)
        again, leads = leaders(hashes, replies.filter(pa.array(kind == 0)), bits)
        leads = np.flatnonzero(leads)
        signs, keys = banded(data, starts[leads], ends[leads], *shape)
        hit = c.answered(keys.ravel(), replies.filter(pa.array(kind == 1)), bits).reshape(-1, shape[0])
        of = np.full(len(hashes), -1)  # a line's place among those with bands in common
        of[leads] = np.where(hit.any(1), np.arange(len(leads)), -1)
        at = np.flatnonzero(again | (of >= 0))
        row = np.searchsorted(firsts, at, "right") - 1
        signatures, bands = [], []
        for j in of[at].tolist():
            signatures.append(signs[j].tobytes() if j >= 0 else None)
            bands.append(np.where(hit[j], keys[j], c.U64(0)).view(np.int64) if j >= 0 else None)
        return pa.table(
            {
                "doc_id": rows.column("doc_id").take(pa.array(row)),
                "__g": pa.array([rows.column("__g")[0].as_py()] * len(at), pa.int64()),
                "row": pa.array(row, pa.int32()),
                "line": pa.array(at - firsts[row], pa.int32()),
                "k": pa.array(hashes[at].view(np.int64)),
                "bytes": pa.array(ends[at] - starts[at], pa.int32()),
                "signature": pa.array(signatures, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }
        )

    return groups.groupBy("__g").cogroup(replies.groupBy("__g")).applyInArrow(run, RECURRING)


PLACE = ["key", "x", "y", "role"]
PLACED = "key LONG, x INT, y INT, role INT, id LONG, component LONG, text STRING, signature BINARY, bands ARRAY<LONG>"


def parts_of(n, sizes):
    """How many parts so many lines with so many bytes are dealt into."""
    return F.ceil(F.greatest(n / F.lit(BLOCK), sizes / F.lit(BLOCK_BYTES))).cast("int")


def turns_for(made, least: int, share) -> int:
    """Turns for so much to post, each of at most the share or least, whichever is more."""
    return max(1, math.ceil((made or 0) / max(least, share or 0)))


def having_likely(rows: pa.Table, heads: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a signature alike enough to another one's of the same key; all rows of a key above WIDE."""
    n = rows.num_rows
    sizes = np.diff(np.append(heads, n))
    left = np.repeat(heads + sizes, sizes) - np.arange(n)  # rows of the key from this one on
    hit = np.repeat(sizes > WIDE, sizes)
    signs = c.text_bytes(rows.column("signature"))[0].reshape(n, -1)
    i, d = np.flatnonzero(~hit), 1
    while len(i := i[left[i] > d]):
        new = i[~(hit[i] & hit[i + d])]
        for at in range(0, len(new), STRETCH):
            own = new[at : at + STRETCH]
            own = own[(signs[own] == signs[own + d]).sum(1) >= least]
            hit[own] = hit[own + d] = True
        d += 1
    return hit


def alike_posts(posts: DataFrame, least: int) -> DataFrame:
    """(key, id, bytes) of those posts (key, id, bytes, signature) whose signature is alike enough to another one's
    under the same key. A pair of lines is likely under all keys they share or none, so no pair is lost."""
    rows = posts.repartition(c.partitions(posts.sparkSession), "key").sortWithinPartitions("key")

    def going_on(rows: pa.Table, hit=None):
        kept = rows.select(["key", "id", "bytes"])
        return (kept if hit is None else kept.filter(pa.array(hit))).to_batches()

    def run(batches):
        held = passing = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if passing is not None:  # the rest of a key above WIDE
                n = int((rows.column("key").to_numpy() == passing).sum())
                yield from going_on(rows.slice(0, n))
                rows = rows.slice(n)
            if not rows.num_rows:
                continue
            passing = None
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            heads = group_heads(rows, ["key"])
            whole = rows.slice(0, heads[-1])
            if whole.num_rows:
                yield from going_on(whole, having_likely(whole, heads[:-1], least))
            held = rows.slice(heads[-1])
            if held.num_rows > WIDE:
                yield from going_on(held)
                held, passing = None, held.column("key")[0].as_py()
        if held is not None:
            yield from going_on(held, having_likely(held, np.zeros(1, np.int64), least))

    return rows.mapInArrow(run, "key LONG, id LONG, bytes INT")


def likely_posts(classes: DataFrame, least: int) -> DataFrame:
    """(key, id, bytes): the keys under which a line may have a link. classes has (k, bytes, signature, bands)."""
    used = classes.withColumn("bands", F.filter("bands", lambda b: b != 0))
    posts, rows = used.agg(F.sum(F.size("bands")), F.count("*")).first()
    turns = turns_for(posts, TURN_POSTS, rows)
    posts = used.select(F.explode("bands").alias("key"), F.col("k").alias("id"), "bytes", "signature")

    def made(turn: int) -> DataFrame:
        return alike_posts(posts.filter(F.pmod(F.xxhash64("key"), F.lit(turns)) == turn), least)

    return in_turns(made, turns)


def dealt(column, parts, turn: int):
    return F.pmod(F.xxhash64(column, F.lit(turn)), parts).cast("int")


def meeting_keys(thin: DataFrame) -> DataFrame:
    """(id, keys): the keys (with their parts) under which each line is compared. thin has (key, id, bytes).

    Near copies share most of their bands, so many keys hold the very same lines: one key of these is
    enough, as every pair of the others meets there. Equal sets have the same number, bytes and hashes.
    Nor is a key needed if all its lines have the same largest key, which then holds all of them."""
    sets = thin.groupBy("key").agg(
        F.count("*").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.bit_xor(F.xxhash64("id")).alias("one"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"),
    )
    once = sets.filter("n > 1").groupBy("n", "bytes", "one", "two").agg(F.min("key").alias("key"))
    once = checkpoint(once.select("n", "key", parts_of(F.col("n"), F.col("bytes")).alias("parts")))
    rows = thin.select("key", "id").join(once, "key")
    # the largest key that is compared in one part; 0 if there is none, as no key is
    whole = F.max(F.when(F.col("parts") == 1, F.struct("n", "key")))["key"]
    rows = checkpoint(rows.join(rows.groupBy("id").agg(F.coalesce(whole, F.lit(0)).alias("top")), "id"))
    tops = rows.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high"))
    needed = tops.filter("low <> high OR low = 0 OR low = key").select("key")
    kept = rows.join(needed, "key", "left_semi")
    return checkpoint(kept.groupBy("id").agg(F.collect_list(F.struct("key", "parts")).alias("keys")))


def posted_at(groups: DataFrame, classes: DataFrame, places: DataFrame, turn: int, turns: int) -> DataFrame:
    """One row per line and place of places (id, component, places), for one turn of the places; bands
    under which the line is not compared become 0. Texts are taken from the groups only here."""
    asked = places.withColumn("used", F.array_distinct(F.transform("places", lambda x: x["key"])))
    asked = asked.withColumn(
        "places", F.filter("places", lambda x: F.pmod(F.xxhash64(x["key"], x["x"], x["y"]), F.lit(turns)) == turn)
    )
    rows = classes.withColumnRenamed("k", "id").join(asked.filter(F.size("places") > 0), "id")
    used = F.transform("bands", lambda b: F.when(F.array_contains("used", b), b).otherwise(F.lit(0)))
    rows = rows.withColumn("bands", used).select(
        "__g", "row", "line", "id", "component", "signature", "bands",
        *(F.col("places")[x].alias(x) for x in PLACE),
    )

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        data, offsets = c.text_bytes(c.by_row_key(rows).column("text"))
        starts, ends, firsts = line_table(data, offsets)
        at = firsts[asked.column("row").to_numpy()] + asked.column("line").to_numpy()
        lists = {x: asked.column(x).combine_chunks() for x in PLACE}
        each = pa.array(np.repeat(np.arange(len(at)), lists["key"].value_lengths().to_numpy()))
        source = data.tobytes()
        texts = pa.array([source[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())
        return pa.table(
            {
                **{x: lists[x].flatten() for x in PLACE},
                "id": asked.column("id").take(each),
                "component": asked.column("component").take(each),
                "text": texts.cast(pa.string()).take(each),
                "signature": asked.column("signature").take(each),
                "bands": asked.column("bands").take(each),
            }
        )

    return groups.groupBy("__g").cogroup(rows.groupBy("__g")).applyInArrow(run, PLACED)


def place(key, x, y, role: int):
    return F.struct(key.alias("key"), x.alias("x"), y.alias("y"), F.lit(role).alias("role"))


def inside_parts(meets: DataFrame) -> DataFrame:
    """(id, component, places): every line in one part of each of its keys."""
    own = F.transform("keys", lambda k: place(k["key"], dealt("id", k["parts"], 1), F.lit(0), -1))
    return meets.select("id", F.col("id").alias("component"), own.alias("places"))


def across_parts(large: DataFrame, sizes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component, places) for the keys with several parts that still hold several components: lines
    outside the key's largest one (role 0) in parts against all lines (role 1) in parts. large has (id, keys),
    sizes (id, bytes)."""
    rows = large.select("id", F.explode("keys.key").alias("key")).join(sizes, "id").join(found, "id", "left")
    rows = checkpoint(rows.withColumn("component", F.coalesce("component", "id")))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    both = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.max(F.struct("n", "component", "bytes")).alias("most"),
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
    )
    both = both.filter("n > most.n").select(
        "key",
        "largest",
        parts_of(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("xs"),
        parts_of(F.col("n"), F.col("bytes")).alias("ys"),
    )
    rows = rows.join(both, "key").select(
        "id", "component", "key", (F.col("component") != F.col("largest")).alias("outside"), "xs", "ys",
        dealt("id", F.col("xs"), 2).alias("x"), dealt("id", F.col("ys"), 3).alias("y"),
    )
    made = rows.groupBy("id").agg(
        F.first("component").alias("component"),
        F.collect_list(F.struct("key", "outside", "xs", "ys", "x", "y")).alias("keys"),
    )
    # the places have the square of a key's parts: they are made from this where they are read

    def places(k):
        asked = F.transform(F.sequence(F.lit(0), k["xs"] - 1), lambda x: place(k["key"], x, k["y"], 1))
        asking = F.transform(F.sequence(F.lit(0), k["ys"] - 1), lambda y: place(k["key"], k["x"], y, 0))
        return F.when(k["outside"], F.concat(asked, asking)).otherwise(asked)

    return checkpoint(made).select("id", "component", F.flatten(F.transform("keys", places)).alias("places"))


def likely(group, role, key, signs, bands, least: int):
    """Pairs of rows of the same group (and of different roles) whose signatures are alike enough, the
    most alike first. A pair is made under the first band that both rows share."""
    found = [np.zeros((3, 0), np.int64)]
    sizes = np.bincount(group)
    for d in range(1, int(sizes.max())):
        i = np.flatnonzero(group[d:] == group[:-d])
        i = i[(role[i] < 0) | (role[i] != role[i + d])]
        alike = (signs[i] == signs[i + d]).sum(1)
        i, alike = i[alike >= least], alike[alike >= least]
        shared = (bands[i] == bands[i + d]) & (bands[i] != 0)
        here = bands[i, shared.argmax(1)] == key[i]
        found.append(np.stack([i[here], i[here] + d, alike[here]]))
    found = np.concatenate(found, axis=1)
    return found[:2, np.argsort(-found[2], kind="stable")]


def piece_links(rows: pa.Table, group: np.ndarray, least: int, percent: int) -> pa.Table:
    """A forest of true links that joins what is linked in these groups, as far as not joined already."""
    ids, keys = rows.column("id").to_numpy(), rows.column("key").to_numpy()
    signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    one, other = likely(group, rows.column("role").to_numpy(), keys, signs, bands, least)
    # rows of one line share their set
    needed, of = np.unique(ids[np.concatenate([one, other])], return_inverse=True)
    at = np.zeros(len(needed), np.int64)
    at[of] = np.concatenate([one, other])
    data, offsets = c.text_bytes(rows.column("text").take(pa.array(at)))
    items, firsts = distinct(*line_sets(data, offsets[:-1], offsets[1:])) if len(at) else (None, None)
    place = np.zeros(len(ids), np.int64)
    place[np.concatenate([one, other])] = of

    def link(i: int, j: int) -> bool:
        x, y = place[i], place[j]
        return c.alike_enough(items[firsts[x] : firsts[x + 1]], items[firsts[y] : firsts[y + 1]], percent)

    found = c.joining(one, other, rows.column("component").to_numpy(), link)
    return c.ordered_pairs(ids[np.array(found, np.int64).reshape(-1, 2)].T)


def links(placed: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) found inside the groups (key, x, y): enough of them to join all that is linked."""
    place = ["key", "x", "y"]
    rows = placed.repartition(c.partitions(placed.sparkSession), *place).sortWithinPartitions(*place)

    def pieces(batches):
        """Whole groups, about BLOCK_BYTES of text at a time, with each row's group."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            heads = group_heads(rows, place)
            if len(heads) > 1:
                yield rows.slice(0, heads[-1])
            held = rows.slice(heads[-1])
        if held is not None:
            yield held

    def run(batches):
        for rows in pieces(batches):
            heads = group_heads(rows, place)
            ends = np.append(heads[1:], rows.num_rows)
            sizes = np.cumsum(c.text_bytes(rows.column("text"))[1][1:])
            at = 0
            while at < len(heads):
                before = sizes[heads[at] - 1] if heads[at] else 0
                to = max(at + 1, int(np.searchsorted(sizes[ends - 1], before + BLOCK_BYTES, "right")))
                piece = rows.slice(heads[at], ends[to - 1] - heads[at]).combine_chunks()
                group = np.repeat(np.arange(to - at), ends[at:to] - heads[at:to])
                for out in piece_links(piece, group, least, percent).to_batches():
                    yield out
                at = to

    return rows.mapInArrow(run, c.PAIRS).distinct()


def group_heads(rows: pa.Table, place: list[str]) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for x in place:
        values = rows.column(x).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def joined(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all lines with a link. classes has k, the line's place, signature and bands.

    Lines of a key meet in parts of about BLOCK lines and are compared there, with their texts; what is
    joined already is not compared again, so a group of near copies costs about one comparison a line.
    Keys with several parts that still hold several components then compare their parts with each
    other. Nothing is left out: a pair is compared under the first band that both lines share."""
    # the size of a set is not known from a line's length: every size may fit
    least = matches(percent, SIGNATURE, SIGNATURE_MISS, 1 / 256)
    share = classes.agg(F.sum("bytes") * TURN_SHARE).first()[0]
    meets = meeting_keys(likely_posts(classes, least))
    c.forget(groups.sparkSession)
    classes = stored(classes.drop("doc_id").join(meets.select(F.col("id").alias("k")), "k", "left_semi"))
    sizes = classes.select(F.col("k").alias("id"), "bytes")

    def compared(places: DataFrame) -> DataFrame:
        n = places.select("id", F.size("places").alias("n")).join(sizes, "id")
        turns = turns_for(n.agg(F.sum(F.col("n") * F.col("bytes"))).first()[0], TURN_BYTES, share)
        return in_turns(lambda t: links(posted_at(groups, classes, places, t, turns), least, percent), turns)

    found = c.components(compared(inside_parts(meets)))
    large = meets.filter(F.exists("keys", lambda x: x["parts"] > 1))
    if large.isEmpty():
        return found
    large = large.withColumn("keys", F.filter("keys", lambda x: x["parts"] > 1))
    found = checkpoint(found)
    return c.components(c.stars(found).unionByName(compared(across_parts(large, sizes, found))))


def in_turns(made, turns: int) -> DataFrame:
    """What made(turn) gives for all turns, one after another; what a turn has shuffled is let go."""
    parts = []
    for turn in range(turns):
        parts.append(checkpoint(made(turn)))
        c.forget(parts[-1].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def line_dedup(docs: DataFrame, percent: int = PERCENT, keep=None) -> DataFrame:
    """Input columns with text cut to the lines that stay, n_lines and n_removed."""
    names = [x for x in (docs.columns if keep is None else keep) if x.lower() not in NEW]
    rows = docs.select(*dict.fromkeys([*names, "doc_id", "text"]))
    # read again at the end: texts are dealt out once. What has no room in memory is read from the files of the
    # shuffle, which stay as long as the groups do: a second copy on disk would only double them
    groups = c.grouped(rows).persist(StorageLevel.MEMORY_ONLY)
    texts = groups.select("doc_id", "text", "__k", "__g")
    lines = stored(recurring(texts, percent))
    c.forget(docs.sparkSession)  # the exchange of band keys is done
    found = joined(texts, lines.filter("bands IS NOT NULL"), percent)
    place = F.struct("doc_id", "__g", "row", "line")
    owned = lines.select("k", *place_columns()).join(found.withColumnRenamed("id", "k"), "k", "left")
    owned = owned.withColumn("component", F.coalesce("component", "k"))
    first = owned.groupBy("component").agg(F.min(place).alias("first"))
    gone = owned.join(first, "component").filter(place != F.col("first")).select("__g", "row", "line")
    fields = [rows.schema[x] if x != "text" else T.StructField("text", T.StringType()) for x in names]
    schema = T.StructType([*fields, *(T.StructField(k, T.LongType()) for k in NEW)])

    def cut(rows: pa.Table, gone: pa.Table) -> pa.Table:
        rows = c.by_row_key(rows)
        removed: dict[int, set[int]] = {}
        for r, line in zip(gone.column("row").to_pylist(), gone.column("line").to_pylist(), strict=True):
            removed.setdefault(r, set()).add(line)
        data, offsets = c.text_bytes(rows.column("text"))
        firsts = line_table(data, offsets)[2]
        texts, source = [], data.tobytes()
        for r in range(len(offsets) - 1):
            text = source[int(offsets[r]) : int(offsets[r + 1])]
            if r in removed:
                parts, number, own = [], 0, removed[r]
                for line in text.split(b"\n"):
                    real = bool(line.strip())
                    if not real or number not in own:
                        parts.append(line)
                    number += real
                text = b"\n".join(parts) if any(x.strip() for x in parts) else b""
            texts.append(text)
        made = {x: rows.column(x) for x in names}
        if "text" in made:
            made["text"] = pa.array(texts, pa.binary()).cast(pa.string())
        made["n_lines"] = pa.array(np.diff(firsts), pa.int64())
        made["n_removed"] = pa.array([len(removed.get(r, ())) for r in range(len(texts))], pa.int64())
        return pa.table(made)

    return groups.groupBy("__g").cogroup(gone.groupBy("__g")).applyInArrow(cut, schema)


def place_columns() -> list[str]:
    return ["doc_id", "__g", "row", "line"]


def op10_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
