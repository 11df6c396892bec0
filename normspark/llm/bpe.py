"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one database per task.

A Python worker keeps the ids of the distinct words (matches of the pattern) it has met. New words go into
DuckDB as rows (word, position, token), one row per byte; a recursive query joins neighbouring
tokens with the merge table, contracts the leftmost pair of lowest rank in each word and stops
where no pair is left. Decoding joins the ids with the token bytes and puts them together by an
ordered aggregation. Words that are tokens themselves take that id, as tiktoken does.

A recursion over one word of n bytes makes up to n * n / 2 rows, so words longer than LONG_WORD
bytes take the same contractions from a heap instead; they are not cached. The cache is emptied when
it holds CACHE_WORDS words, so a task's memory does not grow with the data.

Null texts count as empty: no ids and no bytes. Repeated rows give repeated results; rows never
meet, so there is no shuffle.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LONG_WORD = 96
LONG_PIECE = 256
CACHE_WORDS = 900_000
DECODE_IDS = 1 << 20

#: best packs the lowest rank and the leftmost place of it; places are below 128
ENCODE = """
WITH RECURSIVE state(step, word, pos, token) AS (
    SELECT 0, word, pos, token FROM start
    UNION ALL
    SELECT step + 1, s.word, CASE WHEN pos > best % 128 THEN pos - 1 ELSE pos END,
        CASE WHEN pos = best % 128 THEN best // 128 ELSE token END
    FROM state s JOIN (
        SELECT a.word, min(m.made * 128 + a.pos) AS best
        FROM state a
        JOIN state b ON b.word = a.word AND b.pos = a.pos + 1
        JOIN merges m ON m.l = a.token AND m.r = b.token
        GROUP BY a.word
    ) b ON b.word = s.word
    WHERE pos <> best % 128 + 1
)
SELECT s.word, token
FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY s.word, pos
"""

DECODE = """
SELECT doc, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM ids JOIN vocab v ON v.token = ids.token GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = {i: w for w, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        lefts, rights, made = [], [], []
        for w, i in ranks.items():
            for cut in range(1, len(w)):
                a, b = ranks.get(w[:cut]), ranks.get(w[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    made.append(i)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '256MB'")
        self.load("merges", l=lefts, r=rights, made=made)
        own = {"token": pa.array(list(self.bytes), pa.int32())}
        self.db.register("given", pa.table(own | {"hex": [x.hex() for x in self.bytes.values()]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.uneven = regex.compile(r" \s").search
        self.clear()

    def load(self, name: str, **columns) -> None:
        arrays = {k: pa.array(np.asarray(v, np.int32)) for k, v in columns.items()}
        self.db.register("given", pa.table(arrays))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def clear(self) -> None:
        """Forget all words and pieces."""
        self.words: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # ids of a text's pieces between spaces, each with its space before it
        self.pieces: dict[str, int] = {}
        self.piece_flat, self.piece_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Take new distinct words into the cache."""
        coded = [w.encode() for w in words]
        known = [self.ranks.get(w) for w in coded]
        todo = [i for i, k in enumerate(known) if k is None]
        lengths = np.ones(len(words), np.int64)
        tokens = np.zeros(0, np.int32)
        owner = np.zeros(0, np.int64)
        if todo:
            raw = np.frombuffer(b"".join(coded[i] for i in todo), np.uint8)
            sizes = np.array([len(coded[i]) for i in todo])
            word = np.repeat(np.array(todo), sizes)
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.load("start", word=word, pos=pos, token=self.single[raw])
            out = self.db.execute(ENCODE).fetchnumpy()
            owner, tokens = out["word"].astype(np.int64), out["token"]
            lengths[todo] = np.bincount(owner, minlength=len(words))[todo]
        at = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(int(at[-1]), np.uint32)
        simple = [i for i, k in enumerate(known) if k is not None]
        flat[at[simple]] = [known[i] for i in simple]
        if todo:
            first = np.searchsorted(owner, owner, "left")
            flat[at[owner] + np.arange(len(owner)) - first] = tokens
        base = len(self.words)
        self.words.update(zip(words, range(base, base + len(words)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        self.flat = np.concatenate([self.flat, flat])

    def long_word(self, word: bytes) -> np.ndarray:
        """The same contractions for one long word, from a heap."""
        if word in self.ranks:
            return np.array([self.ranks[word]], np.uint32)
        n = len(word)
        end = list(range(1, n + 1))  # end of the token at a position, 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(self.ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in self.ranks]
        heapq.heapify(heap)

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := self.ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
            offer(before[a], a)
            offer(a, stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return np.array(out, np.uint32)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has. Long words are not cached."""
        new, long = [], {}
        for w in dict.fromkeys(words):
            if len(w) > LONG_WORD // 4 and len(w.encode()) > LONG_WORD:
                long[w] = self.long_word(w.encode())
            elif w not in self.words:
                new.append(w)
        if new:
            self.learn(new)
        if not long:
            which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            return gather(self.flat, self.at, which)
        parts = [long[w] if w in long else gather(self.flat, self.at, [self.words[w]])[0] for w in words]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text.

        A space that no white space follows always begins a match of the pattern, so texts are cut
        there and every distinct piece is matched and encoded once. Other texts, and pieces too long
        to be kept, are matched as they are.
        """
        cut = [t.split(" ") if not self.uneven(t) else None for t in texts]
        pieces = set().union(*(own[1:] for own in cut if own))
        long = {p for p in pieces if len(p) > LONG_PIECE}
        pieces -= long
        new = list(pieces.difference(self.pieces))
        if len(self.pieces) + len(new) > CACHE_WORDS or len(self.words) > CACHE_WORDS:
            self.clear()
            new = list(pieces)
        if new:
            found = [self.find(" " + p) for p in new]
            ids, counts = self.spell([w for words in found for w in words])
            ends = np.concatenate([[0], np.cumsum(counts)])
            of_piece = ends[np.concatenate([[0], np.cumsum([len(x) for x in found])])]
            base = len(self.pieces)
            self.pieces.update(zip(new, range(base, base + len(new)), strict=True))
            self.piece_at = np.concatenate([self.piece_at, self.piece_at[-1] + of_piece[1:]])
            self.piece_flat = np.concatenate([self.piece_flat, ids])
        whole = [own is None or not long.isdisjoint(own[1:]) if long else own is None for own in cut]
        heads = [self.find(t if w else own[0]) for t, own, w in zip(texts, cut, whole, strict=True)]
        ids, counts = self.spell([x for words in heads for x in words])
        ends = np.concatenate([[0], np.cumsum(counts)])
        ends = ends[np.concatenate([[0], np.cumsum([len(x) for x in heads])])]
        out = []
        for i, own in enumerate(cut):
            head = ids[ends[i] : ends[i + 1]]
            if not whole[i]:
                which = np.fromiter(map(self.pieces.__getitem__, own[1:]), np.int64, len(own) - 1)
                rest = gather(self.piece_flat, self.piece_at, which)[0]
                head = np.concatenate([head, rest])
            out.append(head)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of every sequence of ids, in runs of a bounded number of ids."""
        runs, owner, held, out = [], [], 0, [[] for _ in ids]

        def joined():
            sizes = [len(x) for x in runs]
            doc = np.repeat(np.arange(len(runs)), sizes)
            self.load("ids", doc=doc, pos=np.arange(len(doc)), token=np.concatenate(runs))
            for run, text in sorted(self.db.execute(DECODE).fetchall()):
                out[owner[run]].append(bytes.fromhex(text))
            runs.clear()
            owner.clear()

        for i, own in enumerate(ids):
            for a in range(0, len(own), DECODE_IDS):
                runs.append(own[a : a + DECODE_IDS])
                owner.append(i)
                held += len(runs[-1])
                if held >= DECODE_IDS:
                    joined()
                    held = 0
        if runs:
            joined()
        return [b"".join(x) for x in out]


def gather(flat: np.ndarray, at: np.ndarray, which) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat one after another, and their lengths."""
    which = np.asarray(which, np.int64)
    begin, count = at[which], at[which + 1] - at[which]
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(len(shift))], count


def coder(path: str, pattern: str) -> Coder:
    """The coder of this Python worker, kept over its tasks."""
    return c.kept(("bpe", path, pattern), lambda: Coder(load_ranks(path), pattern))


FIELDS = {"n_tokens": "LONG", "ids": "BINARY", "decoded": "BINARY"}


def encode_documents(docs: DataFrame, path: str, pattern: str, keep=None) -> DataFrame:
    """Rows with n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes of the ids)."""

    def run(piece: pa.RecordBatch) -> list[pa.Array]:
        own = coder(path, pattern)
        ids = own.encode([t or "" for t in piece.column("text").to_pylist()])
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            pa.array(own.decode(ids), pa.binary()),
        ]

    return c.extend(docs, run, FIELDS, keep)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = c.table(spark, sf_dir, "documents")
    coded = encode_documents(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
