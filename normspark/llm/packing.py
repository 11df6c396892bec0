"""Cost-balanced packing of token ids into sequences of a fixed length.

Documents are tokenised and packed inside the partition that reads them: no shuffle, and a task
holds the ids of one packing group (a bounded number of tokens, one document at least). In a group
of n tokens there are n // length full sequences. Pieces of full length take one each; the rest is
assigned in descending order to the sequence of lowest attention cost (linear plus quadratic in the
lengths of its pieces) that has room for the whole document. Where no sequence has room for it, the
document is cut: the sequence of lowest cost is filled up and what remains goes on as a smaller
document. So all of these sequences end up exactly full. The n % length tokens left over become
sequences whose lengths are powers of two, which need no padding.

Tokens of a word do not depend on other words (the tokenizer splits at white space and normalises
character by character), so every distinct word is encoded once per cache, which a Python worker
keeps over its tasks; it is emptied when it holds more than CACHE_WORDS words or CACHE_BYTES bytes
of them. Null texts count as empty: one end token.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as c
from .bpe import gather

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22
CACHE_WORDS = 1_000_000
CACHE_BYTES = 64 << 20
#: units encoded at once
JOINED = 200
#: punctuation cut off the end of a word; the marks between units; words that try the short cuts
ENDINGS = ".,;:!?"
MARK, PLAIN_MARK = "\U0001f602", ","
LETTERS = "^[A-Za-z]+$"
TAIL = ",."
PROBE = ["the", "reading", "zqxjkv", "abc1", "s", "d"]
#: cost of a piece of n tokens: n * (LINEAR + n / length)
LINEAR = 4.0


class Places(dict):
    """Places of words, given out in the order in which words are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return place


class WordTokens:
    """Ids of texts through a cache of distinct words.

    A word that ends in punctuation behind an ASCII letter or digit is two units, as the tokenizer
    cuts there anyway; others are one. New units are encoded many at a time with a mark between
    them that none of them holds. Units of ASCII letters need no normalising but lower case and no
    pattern, so they pass a tokenizer with the same merges that only splits at spaces. Both short
    cuts are used only if a probe gives the ids of the plain way.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), cache_words
        self.tokenizer.no_truncation()
        self.plain = Tokenizer.from_str(self.tokenizer.to_str())
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.clear()
        tail = self.usual(TAIL)
        self.cuts = all(self.usual(w + TAIL) == self.usual(w) + tail for w in PROBE)
        self.joins = len(self.usual(MARK)) == len(self.usual(PLAIN_MARK)) == 1
        if self.joins:
            ids, counts = self.encode(pa.array(PROBE))
            self.joins = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [
                self.usual(w) for w in PROBE
            ]

    def clear(self) -> None:
        self.index = Places()
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def usual(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def joined(self, tokenizer, mark: str, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another, and how many each has."""
        sign = np.uint32(self.usual(mark)[0])
        between, parts = f" {mark} ", []
        runs = [between.join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)]
        for i in range(0, len(runs), 64):
            for made in tokenizer.encode_batch_fast(runs[i : i + 64], add_special_tokens=False):
                parts += [np.array(made.ids, np.uint32), sign[None]]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        marks = ids == sign
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after another, and how many each has."""
        kind = np.full(len(units), 2)
        if self.joins:
            holds = pc.match_substring(units, MARK).to_numpy(zero_copy_only=False)
            letters = pc.match_substring_regex(units, LETTERS).to_numpy(zero_copy_only=False)
            kind = np.where(letters, 0, np.where(holds, 2, 1))
        made = []
        for k, tokenizer, mark in ((0, self.plain, PLAIN_MARK), (1, self.tokenizer, MARK)):
            made.append(self.joined(tokenizer, mark, units.filter(pa.array(kind == k)).to_pylist()))
        alone = [self.usual(u) for u in units.filter(pa.array(kind == 2)).to_pylist()]
        made.append((np.array([i for x in alone for i in x], np.uint32), np.array([len(x) for x in alone], np.int64)))
        flat, counts = (np.concatenate(x) for x in zip(*made, strict=True))
        place = np.argsort(np.argsort(kind, kind="stable"), kind="stable")
        return gather(flat, np.concatenate([[0], np.cumsum(counts)]), place)

    def learn(self, words: list[bytes]) -> None:
        """Append the ids of distinct new words."""
        own = pa.array(words, pa.binary()).cast(pa.large_string())
        units, tails = own, np.zeros(len(words), bool)
        if self.cuts:
            stems = pc.ascii_rtrim(own, ENDINGS)
            cut = pc.match_substring_regex(stems, "[A-Za-z0-9]$")
            cut = pc.and_(cut, pc.less(pc.binary_length(stems), pc.binary_length(own)))
            units, tails = pc.if_else(cut, stems, own), cut.to_numpy(zero_copy_only=False)
        ends = pc.binary_length(units).to_numpy()
        if self.joins:
            units = pc.if_else(pc.match_substring_regex(units, LETTERS), pc.ascii_lower(units), units)
        cut_off = [words[i][ends[i] :].decode() for i in np.flatnonzero(tails).tolist()]
        every = pa.concat_arrays([units, pa.array(cut_off, pa.large_string())]).dictionary_encode()
        ids, counts = self.encode(every.dictionary)
        # a word's units: its own, then the one cut off
        first = np.arange(len(words)) + np.cumsum(tails) - tails
        which = np.empty(len(every), np.int64)
        places = every.indices.to_numpy()
        which[first] = places[: len(words)]
        which[first[tails] + 1] = places[len(words) :]
        ids, counts = gather(ids, np.concatenate([[0], np.cumsum(counts)]), which)
        sizes = np.add.reduceat(counts, first)
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of every text and its end id."""
        if len(self.index) > self.most or self.index.bytes > CACHE_BYTES:
            self.clear()
        cut = [t.split() if t else [] for t in texts]
        place = self.index.__getitem__
        which = [np.fromiter(map(place, words), np.int64, len(words)) for words in cut]
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        end = np.array([END_ID], np.uint32)
        return [np.concatenate([gather(self.flat, self.at, x)[0], end]) for x in which]


def word_tokens(path: str) -> WordTokens:
    """The cache of this Python worker, kept over its tasks."""
    return c.kept(("packing", path), lambda: WordTokens(path))


def cost(n: int, length: int) -> float:
    return n * (LINEAR + n / length)


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, piece length, sequence, offset) for documents of these lengths."""
    full, rest = divmod(sum(lengths), length)
    room: list[int] = []
    pieces, waiting = [], []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= length:
            pieces.append((d, start, length, len(room), 0))
            room.append(0)
            start += length
        if start < n:
            waiting.append((start - n, d, start))
    opened = full - len(room)
    ready = [(0.0, s) for s in range(len(room), full)]
    room += [length] * opened
    spent, small = [0.0] * len(room), [False] * len(room)
    by_room: list[tuple[int, int]] = []
    by_cost: list[tuple[float, int]] = []
    tail = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    heapq.heapify(waiting)
    # Lengths never rise from here on: what has room for one document has room for the next, until
    # it takes one. ready holds all sequences with room, the other two heaps the small ones.
    while waiting and opened:
        less, d, start = heapq.heappop(waiting)
        n = -less
        while by_room and -by_room[0][0] >= n:
            left, s = heapq.heappop(by_room)
            if small[s] and room[s] == -left:
                small[s] = False
                heapq.heappush(ready, (spent[s], s))
        if ready:
            s = heapq.heappop(ready)[1]
        else:  # cut it at the cheapest sequence
            was, s = heapq.heappop(by_cost)
            while not small[s] or was != spent[s]:
                was, s = heapq.heappop(by_cost)
            small[s] = False
        take = min(n, room[s])
        pieces.append((d, start, take, s, length - room[s]))
        room[s] -= take
        spent[s] += cost(take, length)
        if not room[s]:
            opened -= 1
        elif room[s] >= n:
            heapq.heappush(ready, (spent[s], s))
        else:
            small[s] = True
            heapq.heappush(by_room, (-room[s], s))
            heapq.heappush(by_cost, (spent[s], s))
        if take < n:
            heapq.heappush(waiting, (take - n, d, start + take))
    # the rest: sequences of a power of two
    s, left, offset = full - 1, 0, 0
    sizes = iter(tail)
    while waiting:
        less, d, start = heapq.heappop(waiting)
        n = -less
        while n:
            if not left:
                s, left, offset = s + 1, next(sizes), 0
            take = min(n, left)
            pieces.append((d, start, take, s, offset))
            start, n, left, offset = start + take, n - take, left - take, offset + take
    return pieces


PIECES = (
    "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG,"
    " sequence_id LONG, offset LONG"
)


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """One row per piece; sequence ids are unique over all partitions."""

    def run(batches):
        words = word_tokens(tokenizer)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def packed():
            nonlocal number
            rows = pack([len(ids) for _, ids in held], length)
            crcs = [zlib.crc32(held[d][1][a : a + n].tobytes()) for d, a, n, _, _ in rows]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[r[0]][0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([len(held[r[0]][1]) for r in rows], pa.int64()),
                    pa.array([number + r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )
            number += 1 + max((r[3] for r in rows), default=0)
            held.clear()
            return out

        for piece in c.slices(batches):
            made = words.ids(piece.column("text").cast(pa.binary()).to_pylist())
            for doc, ids in zip(piece.column("doc_id").to_pylist(), made, strict=True):
                held.append((doc, ids))
                size += len(ids)
                if size >= group_tokens:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op8_cost_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = c.table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
