"""Substring dedup by relative Lempel-Ziv parsing.

The whole corpus is the reference. It is cut into index blocks by the leading bits of a window's
fingerprint, so that every window of every document is held by exactly one block and every block is
a small task of its own. A document is factored against all blocks: each of its windows is looked
up in the block that would hold it, and the greedy parse walks the answers from left to right. Where
a window is held elsewhere a factor starts; it grows as long as the window that ends with the next
word is held too. At the boundary where a factor ends, the windows that lie across the boundary have
their own answers, so a long match that begins inside a factor starts the next factor there and
nothing is lost to greediness. Factors of at least `window` words are duplicate spans; everything
else is literal.

What travels is 8 bytes per window (packed by group and block, once per distinct window of a group)
and one bit back. Documents are shuffled once. Fingerprints are 64 bits: among N windows the chance
that any one is misjudged is below N*N / 2**65.

Null and blank texts have no words; texts below `window` words have no window and stay whole. Equal
rows are different documents and therefore copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW = 35
NEW = {"n_words": "LONG", "n_removed": "LONG", "factors": "ARRAY<STRUCT<start: LONG, words: LONG>>"}


def windows(rows: pa.Table, window: int):
    data, offsets = c.text_bytes(rows.column("text"))
    starts, ends, firsts = c.word_bounds(data, offsets)
    inside = c.whole_windows(firsts, window)
    prints = c.chain(c.span_hashes(data, starts, ends), window)
    return data, starts, ends, firsts, inside, prints[inside]


def parse(found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of one run of words: starts and lengths in words of all long factors.

    found[i] says whether the window at word i is held by the index. A factor takes in every
    following window that is held; the next factor starts at the first held window after its last
    one, which may lie inside the factor's last window - 1 words.
    """
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end - start + window - 1


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep=None) -> DataFrame:
    """Input columns with text replaced by the kept words joined by one space (empty if none),
    n_words, n_removed and the duplicate factors (start and length in words)."""
    names = list(docs.columns if keep is None else keep)
    names = [x for x in names if x.lower() not in NEW]
    rows = docs.select(*dict.fromkeys([*names, "doc_id", "text"]))
    groups = c.grouped(rows)
    bits = c.block_bits(docs.sparkSession)
    answers = c.found_elsewhere(c.posted(groups, lambda t: windows(t, window)[-1]))
    fields = [rows.schema[x] if x != "text" else T.StructField("text", T.StringType()) for x in names]
    added = [T.StructField(k, T._parse_datatype_string(v)) for k, v in NEW.items()]
    schema = T.StructType([*fields, *added])
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def factored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        data, starts, ends, firsts, inside, prints = windows(rows, window)
        n = len(starts)
        held = np.zeros(max(0, n - window + 1), bool)
        held[inside] = c.answered(prints, answers, bits)
        at, length = parse(held, window)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + length, -1)
        gone = np.cumsum(mark)[:n] > 0
        row = np.searchsorted(firsts, at, "right") - 1
        texts, source = [], data.tobytes()
        for i in range(len(firsts) - 1):
            a, b = int(firsts[i]), int(firsts[i + 1])
            own = source[int(starts[a]) : int(ends[b - 1])].split() if b > a else []
            if gone[a:b].any():
                own = [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g]
            texts.append(b" ".join(own))
        found = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row, np.arange(len(firsts))), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(at - firsts[row], pa.int64()), pa.array(length, pa.int64())],
                names=["start", "words"],
            ),
        ).cast(span)
        made = {x: rows.column(x) for x in names}
        if "text" in made:
            made["text"] = pa.array(texts, pa.binary()).cast(pa.string())
        made["n_words"] = pa.array(np.diff(firsts), pa.int64())
        made["n_removed"] = pa.array(c.per_row(gone, firsts), pa.int64())
        made["factors"] = found
        return pa.table(made)

    return (
        groups.groupBy("__g").cogroup(answers.groupBy("__g")).applyInArrow(factored, schema)
    )


def op2_relative_lz(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    parsed = substring_dedup(docs)
    return parsed.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


#: the window rule said plainly: every window of every document by its words
ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT k, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
    FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), again AS (
    SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS p FROM windows SEMI JOIN again USING (h)
), kept AS (
    SELECT k, string_agg(word, ' ' ORDER BY p) AS t
    FROM (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (k, p) GROUP BY k
), removed AS (
    SELECT k, count(*) AS n FROM gone GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (k) LEFT JOIN kept USING (k)
"""
