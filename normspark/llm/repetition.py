"""Quality rules on repetition inside one document, from a suffix array of its words.

Suffixes of all documents of a piece are sorted by prefix doubling, and only suffixes whose prefix
repeats in their document are sorted further.
Neighbours' longest common prefixes give the repeats: the longest repeat at a word is the larger of
its two neighbour values, and a repeat is maximal if the word before it does not lengthen it. The
spans of all maximal repeats of at least `min_words` words are united; a document fails if they
cover more than `most_covered` of its words or if one repeat is longer than `most_repeat` words.

Rows never meet, so there is no shuffle and no hot key. Null, empty and blank texts have no words:
all counts are 0 and the base rule fails them. Texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_COVERED = 0.15
MOST_REPEAT = 60
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20

FIELDS = {
    "n_words": "LONG",
    "word_chars": "LONG",
    "n_symbols": "LONG",
    "n_dup_lines": "LONG",
    "n_repeat_words": "LONG",
    "base_failed": "BOOLEAN",
    "kept": "BOOLEAN",
    "n_covered": "LONG",
    "longest_repeat": "LONG",
}


def places(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values, where each one's run of equal values begins and ends."""
    edge = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
    at = np.flatnonzero(edge)
    lengths = np.diff(at)
    return np.repeat(at[:-1], lengths), np.repeat(at[1:], lengths)


class Suffixes:
    """Suffix array of the words of several documents, as far as prefixes repeat.

    levels[k][i] is the rank of the first sizes[k] words at i within its document; equal ranks mean
    equal words, and what reaches over a document's end is never equal to anything. order holds the
    suffixes whose first four words repeat in their document, sorted.
    """

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        n = len(words)
        row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        self.end = firsts[1:][row]
        live, keys = np.arange(n), c.mix(words + c.mix(row.astype(c.U64)))
        level, size = np.zeros(n, np.int64), 1
        self.sizes, self.levels, self.order = [], [], np.zeros(0, np.int64)
        while len(live):
            by_key = np.argsort(keys, kind="stable")
            first, last = places(keys[by_key])
            ordered = live[by_key]
            if self.levels:  # a refined rank lies inside the place of the old one
                old = level[ordered]
                first, last = old + first - places(old)[0], old + last - places(old)[0]
            level = level.copy()
            level[ordered] = first + (not self.levels)
            self.sizes.append(size)
            self.levels.append(level)
            live = ordered[last - first > 1]
            if size == 4:
                self.order = live
            following = live + size
            ok = following < self.end[live]
            keys = level[live] * (n + 2)
            keys[ok] += level[following[ok]] + 1
            size *= 2
        final = self.levels[-1][self.order] if self.levels else self.order
        self.order = self.order[np.argsort(final, kind="stable")]

    def lcp(self) -> np.ndarray:
        """Common prefix in words of each sorted suffix with the one before it."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        total, end = np.zeros(len(a), np.int64), self.end[a]
        same = end == self.end[b]
        for size, level in zip(reversed(self.sizes), reversed(self.levels), strict=True):
            ok = same & (np.maximum(a, b) + size <= end)
            ok[ok] = level[a[ok]] == level[b[ok]]
            a, b, total = a + size * ok, b + size * ok, total + size * ok
        return np.concatenate([[0], total])


def repeats(words: np.ndarray, firsts: np.ndarray, min_words: int = MIN_WORDS):
    """Words in repeated windows, words under maximal repeats, and the longest repeat, by row."""
    n = len(words)
    if n < WINDOW:
        zero = np.zeros(len(firsts) - 1, np.int64)
        return zero, zero, zero
    suffixes = Suffixes(words, firsts)
    longest = np.zeros(n + 1, np.int64)
    if len(suffixes.order):
        lcp = np.append(suffixes.lcp(), 0)
        longest[suffixes.order] = np.maximum(lcp[:-1], lcp[1:])
    window = longest[: n - WINDOW + 1] >= WINDOW
    in_windows = c.per_row(c.covered(window, WINDOW, n), firsts)
    at = np.flatnonzero(longest[:n] >= min_words)
    before = np.where(at > 0, longest[at - 1], 0)
    at = at[before != longest[at] + 1]  # not lengthened by the word before: maximal
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + longest[at], -1)
    spans = c.per_row(np.cumsum(mark)[:n] > 0, firsts)
    most = np.zeros(len(firsts) - 1, np.int64)
    np.maximum.at(most, np.searchsorted(firsts, at, "right") - 1, longest[at])
    return in_windows, spans, most


def measure(piece: pa.RecordBatch, min_words, most_covered, most_repeat) -> list[pa.Array]:
    data, offsets = c.text_bytes(piece.column("text"))
    starts, ends, firsts = c.word_bounds(data, offsets)
    n_words = np.diff(firsts)
    lead = (data & 0xC0) != 0x80  # first bytes of code points
    chars = c.per_row(lead & ~c.SPACE[data], offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = c.per_row(symbol[data], offsets)
    source = data.tobytes()
    dup_lines = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in source[a:b].split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    words = c.span_hashes(data, starts, ends)
    in_windows, spans, most = repeats(words, firsts, min_words)
    failed = (n_words < FEWEST_WORDS) | (100 * in_windows > MOST_REPEATED_PERCENT * n_words)
    kept = ~failed & (spans <= most_covered * n_words) & (most <= most_repeat)
    numbers = [n_words, chars, symbols, np.array(dup_lines, np.int64), in_windows]
    return [
        *[pa.array(x, pa.int64()) for x in numbers],
        pa.array(failed),
        pa.array(kept),
        pa.array(spans, pa.int64()),
        pa.array(most, pa.int64()),
    ]


def repetition_rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    most_covered: float = MOST_COVERED,
    most_repeat: int = MOST_REPEAT,
    keep=None,
) -> DataFrame:
    return c.extend(
        docs, lambda p: measure(p, min_words, most_covered, most_repeat), FIELDS, keep
    )


def op1_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(c.table(spark, sf_dir, "documents"), keep=["doc_id"])
