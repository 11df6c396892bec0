"""Suffix-array dedup with a run-length index.

A byte string of LENGTH bytes that starts at two places has the same sampled anchor at the same
place inside it: of its GRAM-byte substrings the one with the smallest hash. So all comparisons
happen between places with equal anchors.

1. Anchors are taken from all texts and exchanged as packed fingerprints; only those that start
   elsewhere too stay. Around each, the strings of LENGTH bytes that it was sampled from are cut
   out as one context.
2. Contexts meet by anchor. Equal contexts are one, with a count. For the distinct contexts of an
   index block a suffix array is sorted and its Burrows-Wheeler transform kept as runs, with the
   suffix positions sampled at both ends of each run. Longest matches are computed at the run ends
   only; between two samples the match of the next position is one byte shorter, so streaming over
   the text from one sample to the next gives the matching statistics of every position.
3. Positions that match at least LENGTH bytes with a neighbour lie in one interval of the suffix
   array; where an interval holds two different places of the corpus (or a context that stands
   twice), all its strings are marked, and the marks go back to their documents.

Contexts are grouped by anchor and the anchors by blocks. An anchor with more than GROUP_BYTES of
distinct contexts in a block (a passage shorter than LENGTH in very many documents) does not enter
the index: its contexts are compared through fingerprints of their LENGTH-byte strings, exchanged
like the anchors, in the same way for any number of them.

Null texts are empty. Texts below LENGTH bytes hold no such string and stay whole. Equal rows are
different documents, hence copies. Fingerprints have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normspark.operators.keyed import checkpoint

from . import common as c

LENGTH = 400
GRAM = 100
GROUP_BYTES = 1 << 20
#: strings looked at in one step of sampling, few enough for the CPU cache
STRETCH = 1 << 16
NEW = {"n_bytes": "LONG", "n_removed": "LONG", "n_spans": "LONG", "kept": "BINARY"}


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    return c.chain(c.BYTE_VALUE[data], gram)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive values."""
    n, span, level = len(values) - width + 1, 1, values
    while span * 2 <= width:
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    return np.minimum(level[:n], level[width - span : width - span + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Places of the sampled grams (the smallest of every string of `length` bytes inside one row),
    their hashes, and from where to where the strings reach that each is the smallest of."""
    inside = c.whole_windows(offsets, length)
    width = length - gram + 1
    picks, runs = [], []
    for at in range(0, len(inside), STRETCH):  # strings that start in this stretch
        ok = inside[at : at + STRETCH]
        grams = np.maximum(byte_grams(data[at : at + len(ok) + length - 1], gram), c.U64(1))
        low = np.where(ok, sliding_min(grams, width), c.U64(0))
        # a gram is sampled if it is the smallest of a window; equal hashes are all sampled
        reach = np.zeros(len(grams) + width - 1, c.U64)
        reach[width - 1 : width - 1 + len(low)] = low
        # the largest of the minima of the windows that hold it: equal to it if it is one
        pick = np.flatnonzero(~sliding_min(~reach, width) == grams)
        picks.append((pick + at, grams[pick]))
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        tail = np.append(head[1:], len(low)) - 1
        real = low[head] > 0
        runs.append((low[head][real], head[real] + at, tail[real] + at))
    if not any(len(low) for low, _, _ in runs):
        return np.zeros(0, np.int64), np.zeros(0, c.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, hashes = (np.concatenate(x) for x in zip(*picks, strict=True))
    places, once = np.unique(places, return_index=True)
    return places, hashes[once], *sampled_by(runs, places, hashes[once], width, length)


def sampled_by(runs: list, places: np.ndarray, hashes: np.ndarray, width: int, length: int):
    """Where the first string begins and the last one ends with each gram inside as its smallest. The
    strings of a gram begin next to each other, so they lie in one run of equal minima."""
    low, head, tail = (np.concatenate(x) for x in zip(*runs, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (head[1:] > tail[:-1] + 1)])[: len(low)])
    low, head, tail = low[new], head[new], tail[np.append(new[1:], len(tail)) - 1]
    number = np.unique(np.concatenate([low, hashes]), return_inverse=True)[1]
    scale = int(places[-1]) + 1 if len(places) else 1
    key, own = number[: len(low)] * scale + head, number[len(low) :] * scale + places
    order = np.argsort(key)
    run = order[np.searchsorted(key[order], own, "right") - 1]
    return np.maximum(head[run], places - width + 1), np.minimum(tail[run], places) + length


# --- the index of one block ---


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Sorted suffixes by prefix doubling, and for every prefix length on the way the ranks of all
    prefixes of that length; the text ends with symbols that occur once."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    size = max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(size, text.dtype)]).astype(np.int64)
    key = padded[:n]
    for k in range(1, size):
        key = (key << bits) | padded[k : k + n]
    live = slot = np.arange(n)  # suffixes not yet alone, and the places in the order they share out
    rank, levels = np.zeros(n + 1, np.int32), []
    while len(live):
        by_key = np.argsort(key, kind="stable")  # in runs already
        live, key = live[by_key], key[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        rank[live] = np.maximum.accumulate(np.where(new[:-1], slot, 0)) + 1
        levels.append((size, rank.copy()))
        tied = ~(new[:-1] & new[1:])
        live, slot = live[tied], slot[tied]
        # tied suffixes have `size` symbols in common, so none of these ends the text
        key = rank[live].astype(np.int64) * (n + 2) + rank[live + size]
        size *= 2
    out = np.empty(n, np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out, levels


def common_prefix(text: np.ndarray, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of different suffixes a and b."""
    n, total = len(text), np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    for size, rank in reversed(levels):
        same = (rank[a] == rank[b]) & (a < n) & (b < n)
        a, b, total = np.minimum(a + size * same, n), np.minimum(b + size * same, n), total + size * same
    padded = np.append(text, -1)
    live = np.arange(len(a))
    for _ in range(levels[0][0]):
        live = live[(padded[a[live]] == padded[b[live]]) & (a[live] < n)]
        a[live], b[live], total[live] = a[live] + 1, b[live] + 1, total[live] + 1
    return total


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text with suffix positions at the run ends."""

    def __init__(self, text: np.ndarray):
        self.text = text
        self.order, self.levels = suffix_array(text)
        before = text[self.order - 1]  # the transform
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.runs = before[heads]
        self.heads = self.order[heads]  # sampled at the first place of each run
        self.tails = self.order[np.append(heads[1:], len(text)) - 1]  # and at the last

    def matches(self) -> np.ndarray:
        """For every position, its longest match with the suffix sorted before it.

        Only at a run's head is it computed, against the tail of the run before; from there on it
        shrinks by one with each position until the next sample."""
        sampled = np.full(len(self.text), -1, np.int64)
        sampled[self.heads[0]] = 0
        sampled[self.heads[1:]] = common_prefix(
            self.text, self.levels, self.heads[1:], self.tails[:-1]
        )
        at = np.arange(len(self.text))
        reach = np.where(sampled >= 0, sampled + at, 0)
        return np.maximum(np.maximum.accumulate(reach) - at, 0)


def repeated_places(contexts: list[bytes], source: list[np.ndarray], twice: np.ndarray, length: int):
    """Which positions of the contexts start a string of `length` bytes that starts at two places.

    source holds for each context the place in the corpus of its first byte and the row, packed so
    that equal numbers mean the same place; twice says that the whole context stands at two places.
    Returns (context, position) arrays.
    """
    sizes = np.array([len(x) for x in contexts])
    raw = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int32)
    m = len(contexts)
    at = np.cumsum(sizes) - sizes + np.arange(m)
    text = np.empty(len(raw) + m, np.int32)
    keep = np.ones(len(text), bool)
    keep[at + sizes] = False
    text[keep] = raw + m
    text[at + sizes] = np.arange(m)  # every context ends with a symbol of its own
    index = RunIndex(text)
    match = index.matches()
    # intervals of suffixes whose first `length` bytes are equal
    joined = match[index.order] >= length
    owner = np.repeat(np.arange(m), sizes + 1)
    position = np.arange(len(text)) - at[owner]
    place = (source[owner] + position)[index.order]
    group = np.cumsum(~joined) - 1
    firsts = np.flatnonzero(~joined)
    several = np.minimum.reduceat(place, firsts) != np.maximum.reduceat(place, firsts)
    several |= np.logical_or.reduceat(twice[owner[index.order]], firsts)
    hit = several[group] & (position + length <= sizes[owner])[index.order]
    found = index.order[hit]
    return owner[found], position[found]


# --- exchange of contexts ---

CONTEXTS = "__block INT, __g LONG, facts BINARY, bytes BINARY"
MARKS = "__g LONG, hot BOOLEAN, facts BINARY"
FACTS = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("row", "<u4"), ("start", "<u4"), ("size", "<u4"), ("sent", "<u4")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])


def cut_contexts(rows: pa.Table, answers: pa.Table, length: int, gram: int, bits: int):
    """Contexts of the anchors that start elsewhere too: facts and the bytes of a group's texts."""
    data, offsets = c.text_bytes(rows.column("text"))
    places, hashes, start, end = anchors(data, offsets, length, gram)
    hit = c.answered(hashes, answers, bits)
    # equal grams near each other may be sampled from the same strings: these are one context
    hit[1:] &= (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    places, hashes, start, end = places[hit], hashes[hit], start[hit], end[hit]
    row = np.searchsorted(offsets, places, "right") - 1
    facts = np.zeros(len(places), FACTS)
    facts["anchor"], facts["row"] = hashes, row
    facts["start"], facts["size"] = start - offsets[row], end - start
    return data, offsets, start, end, facts


def context_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of overlapping spans, a bounded stretch of data at a time."""
    out = np.empty(len(start), c.U64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + (1 << 20), "right")))
        stop = int(end[at:to].max())
        up, down = c.powers(stop - base + 1)
        total = np.zeros(stop - base + 1, c.U64)
        np.cumsum(c.BYTE_VALUE[data[base:stop]] * up[:-1], out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = c.mix((total[e] - total[s]) * down[s] + (e - s).astype(c.U64))
        at = to
    return out


def contexts_of(groups: DataFrame, answers: DataFrame, length: int, gram: int) -> DataFrame:
    bits = c.block_bits(groups.sparkSession)
    n_blocks = np.uint64(2 * c.partitions(groups.sparkSession))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = c.by_row_key(rows)
        data, _, start, end, facts = cut_contexts(rows, answers, length, gram, bits)
        facts["content"] = context_hash(data, start, end)
        block = (facts["anchor"] % n_blocks).astype(np.int32)
        order = np.lexsort((facts["content"], facts["anchor"], block))
        facts, block, start, end = facts[order], block[order], start[order], end[order]
        new = np.ones(len(facts), bool)
        new[1:] = (facts["content"][1:] != facts["content"][:-1]) | (facts["anchor"][1:] != facts["anchor"][:-1])
        facts["sent"] = new
        source, group = data.tobytes(), rows.column("__g")[0].as_py()
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks, texts, own = [], [], []
        edges = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0, [True]])) if len(block) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            sent = np.flatnonzero(new[a:b]) + a
            blocks.append(int(block[a]))
            own.append(facts[a:b].tobytes())
            texts.append(pack(b"".join(source[int(start[i]) : int(end[i])] for i in sent)))
        return pa.table(
            {
                "__block": pa.array(blocks, pa.int32()),
                "__g": pa.array([group] * len(blocks), pa.int64()),
                "facts": pa.array(own, pa.binary()),
                "bytes": pa.array(texts, pa.binary()),
            }
        )

    return groups.groupBy("__g").cogroup(answers.groupBy("__g")).applyInArrow(run, CONTEXTS)


def marked(contexts: DataFrame, length: int) -> DataFrame:
    """Spans to remove by group, and the contexts (as spans) of anchors too frequent to index."""

    def run(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        facts, group, texts = [], [], []
        for g, f, t in zip(rows.column("__g").to_pylist(), rows.column("facts").to_pylist(), rows.column("bytes").to_pylist(), strict=True):
            own = np.frombuffer(f, FACTS)
            facts.append(own)
            group.append(np.full(len(own), g, np.int64))
            at, text = 0, unpack(t)
            for size, sent in zip(own["size"].tolist(), own["sent"].tolist(), strict=True):
                texts.append(text[at : at + size] if sent else None)
                at += size if sent else 0
        facts, group = np.concatenate(facts), np.concatenate(group)
        spans = {False: [], True: []}

        def mark(hot: bool, which: np.ndarray, start, end) -> None:
            own = np.zeros(len(which), SPAN)
            own["row"], own["start"], own["end"] = facts["row"][which], start, end
            spans[hot].append((group[which], own))

        # one of each distinct context, preferring those whose bytes came along
        order = np.lexsort((~facts["sent"].astype(bool), facts["content"], facts["anchor"]))
        new = np.ones(len(order), bool)
        new[1:] = (facts["content"][order][1:] != facts["content"][order][:-1]) | (facts["anchor"][order][1:] != facts["anchor"][order][:-1])
        klass = np.cumsum(new) - 1
        copies = np.bincount(klass)
        first = order[new]
        size = facts["size"][first].astype(np.int64)
        # contexts that stand twice are repeated as a whole
        whole = order[(copies[klass] > 1) & (size[klass] >= length)]
        mark(False, whole, facts["start"][whole], facts["start"][whole] + facts["size"][whole])
        anchor = facts["anchor"][first]
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        batch: list[np.ndarray] = []
        held = 0

        def indexed() -> None:
            nonlocal held
            own = np.concatenate(batch)  # classes
            reps = first[own]
            # a place of the corpus: group and row numbered, and the byte
            keys = np.unique(np.stack([group[reps], facts["row"][reps].astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
            source = (keys.astype(np.int64) << 32) + facts["start"][reps]
            ctx, pos = repeated_places([texts[i] for i in reps], source, copies[own] > 1, length)
            # copies of a context repeat what it repeats; those were marked as a whole above
            mark(False, reps[ctx], facts["start"][reps[ctx]] + pos, facts["start"][reps[ctx]] + pos + length)
            batch.clear()
            held = 0

        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            own = np.arange(a, b)
            total = int(size[own].sum())
            if total > GROUP_BYTES:
                members = order[(klass >= a) & (klass < b)]
                mark(True, members, facts["start"][members], facts["start"][members] + facts["size"][members])
                continue
            batch.append(own)
            held += total
            if held > GROUP_BYTES:
                indexed()
        if batch:
            indexed()
        out = []
        for hot, found in spans.items():
            if not found:
                continue
            groups, own = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            by = np.lexsort((own["start"], own["row"], groups))
            groups, own = groups[by], own[by]
            for g in np.unique(groups):
                a, b = np.searchsorted(groups, [g, g + 1])
                out.append((int(g), hot, merged(own[a:b]).tobytes() if not hot else own[a:b].tobytes()))
        return pa.table(
            {
                "__g": pa.array([x[0] for x in out], pa.int64()),
                "hot": pa.array([x[1] for x in out], pa.bool_()),
                "facts": pa.array([x[2] for x in out], pa.binary()),
            }
        )

    return contexts.groupBy("__block").applyInArrow(run, MARKS)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans sorted by row and start."""
    if not len(spans):
        return spans
    key = (spans["row"].astype(np.int64) << 32) + spans["start"]
    end = (spans["row"].astype(np.int64) << 32) + spans["end"]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], key[1:] > reach[:-1]])
    out = spans[new].copy()
    last = np.append(np.flatnonzero(new)[1:], len(spans)) - 1
    out["end"] = (reach[last] & 0xFFFFFFFF).astype(np.uint32)
    return out


def removal(answers: pa.Table, offsets: np.ndarray, n: int) -> np.ndarray:
    """Marked bytes of a group."""
    change = np.zeros(n + 1, np.int32)
    for x in answers.column("facts").to_pylist():
        own = np.frombuffer(x, SPAN)
        base = offsets[own["row"].astype(np.int64)]
        np.add.at(change, base + own["start"], 1)
        np.add.at(change, base + own["end"], -1)
    return np.cumsum(change)[:n] > 0


def hot_strings(rows: pa.Table, spans: pa.Table, length: int):
    """Places and fingerprints of all strings of `length` bytes inside the spans."""
    data, offsets = c.text_bytes(rows.column("text"))
    inside = removal(spans, offsets, len(data))
    own = np.zeros(len(data) + 1, np.int32)
    for x in spans.column("facts").to_pylist():
        s = np.frombuffer(x, SPAN)
        base = offsets[s["row"].astype(np.int64)]
        ok = s["end"].astype(np.int64) - s["start"] >= length
        np.add.at(own, (base + s["start"])[ok], 1)
        np.add.at(own, (base + s["end"] - length + 1)[ok], -1)
    places = np.flatnonzero(np.cumsum(own)[:-1] > 0)
    if not len(places):
        return inside, offsets, places, np.zeros(0, c.U64)
    prints = []
    for at in range(0, len(data), 1 << 20):
        a, b = np.searchsorted(places, [at, at + (1 << 20)])
        if b > a:
            base = int(places[a])
            grams = byte_grams(data[base : int(places[b - 1]) + length], length)
            prints.append(grams[places[a:b] - base])
    return inside, offsets, places, np.concatenate(prints)


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    groups = c.grouped(docs.select("doc_id", "text"))
    bits = c.block_bits(docs.sparkSession)

    def sampled(rows: pa.Table) -> np.ndarray:
        return anchors(*c.text_bytes(rows.column("text")), length, gram)[1]

    answers = c.found_elsewhere(c.posted(groups, sampled))
    marks = checkpoint(marked(contexts_of(groups, answers, length, gram), length))

    def hot_posts(rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows = c.by_row_key(rows)
        spans = spans.filter(spans.column("hot"))
        values = hot_strings(rows, spans, length)[3]
        return c.pack_fingerprints(values, rows.column("__g")[0].as_py() if len(rows) else 0, bits)

    both = groups.groupBy("__g").cogroup(marks.groupBy("__g"))
    hot = c.found_elsewhere(both.applyInArrow(hot_posts, c.BLOBS))
    notes = marks.select("__g", "hot", "facts", F.lit(None).cast("int").alias("__block"), F.lit(None).cast("binary").alias("payload")).unionByName(
        hot.select("__g", F.lit(None).cast("boolean").alias("hot"), F.lit(None).cast("binary").alias("facts"), "__block", "payload")
    )
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in NEW.items())]
    )

    def cut(rows: pa.Table, notes: pa.Table) -> pa.Table:
        rows = c.by_row_key(rows)
        data, offsets = c.text_bytes(rows.column("text"))
        is_hot = notes.column("hot").to_numpy(zero_copy_only=False)
        cold = notes.filter(pa.array([x is not None and not x for x in is_hot.tolist()], pa.bool_()))
        gone = removal(cold, offsets, len(data))
        spans = notes.filter(pa.array([bool(x) for x in is_hot.tolist()], pa.bool_()))
        if len(spans):
            _, _, places, prints = hot_strings(rows, spans, length)
            found = c.answered(
                prints, notes.filter(pa.array([x is None for x in is_hot.tolist()], pa.bool_())), bits
            )
            change = np.zeros(len(data) + 1, np.int32)
            change[places[found]] += 1
            change[places[found] + length] -= 1
            gone |= np.cumsum(change)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = gone[edges]
        left = ~gone
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(c.per_row(gone, offsets), pa.int64()),
                "n_spans": pa.array(c.per_row(begins, offsets), pa.int64()),
                "kept": c.binaries(data[left], np.concatenate([[0], np.cumsum(c.per_row(left, offsets))])),
            }
        )

    return groups.groupBy("__g").cogroup(notes.groupBy("__g")).applyInArrow(cut, schema)


def op4_run_index(spark, sf_dir: str) -> DataFrame:
    parsed = substring_dedup(c.table(spark, sf_dir, "documents"))
    return parsed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
