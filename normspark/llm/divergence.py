"""Source divergence audit: a frequent-pattern tree of term rows.

For every language, how far its sources differ in the terms they use, and which terms each source uses
more than the language does. A term is a maximal run of letters, A-Z lower-cased; a language keeps
the terms that at least MIN_DOCS of its documents hold. Each group (lang, source) gives a kept term
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two groups differ by floor((p - q)^2 / (p + q))
in it, all in integers.

Summing that over all terms for all pairs of sources costs terms x sources x sources. The tree saves
most of it: a term's row is the list of its (source, count) in the order of sources, without zero
counts. Equal rows are counted, rows are sorted by range, and each task builds the trees of its range,
one per batch of rows: rows with the same beginning share its nodes, which carry how many terms pass. With
f the difference and 0 the count of an absent term, a pair's sum over the V terms is

    V f(0, 0)  +  sum over (source, count) of  [f(count, 0) - f(0, 0)]
               +  sum over nodes and ancestors of  [f(c, d) - f(c, 0) - f(0, d) + f(0, 0)]

where every bracket is counted as often as terms pass. The last sum is taken once for each node and
ancestor, by array steps over all nodes of a batch.

Skew: terms are counted inside the tasks, then by (lang, source, term) with map-side sums, so neither
a hot source nor a hot word gathers rows. A (source, count) table has at most sqrt(2 N) rows per group,
as N is the sum of its counts. The list of groups (one row per lang and source) goes to the tasks; the
result itself has the square of that list's rows, so the list is small wherever the result is feasible.

Null text, lang and source count as ''; equal rows count as often as they occur; texts of any length
are counted whole, in pieces of rows; an empty table gives an empty result; other columns are ignored.
Sums stay exact up to 9e15 words in a language.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.operators.keyed import stored

from . import common, salted

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: bytes of text counted at once
PIECE = 4 << 20
#: pair sums a task holds before it passes them on
HELD = 1 << 20
#: pairs of node and ancestor worked on at once
STRETCH = 1 << 19

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


# --- counting terms ---


def piece_counts(piece: pa.RecordBatch) -> list[pa.Array]:
    """lang, source, term, occurrences and documents of one piece."""
    data, offsets = common.text_bytes(piece.column("text"))
    inside = LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) + 1 - starts)
    row = np.searchsorted(offsets, starts, "right") - 1
    letters = common.FOLD[data[inside]]
    terms = common.binaries(letters, np.concatenate([[0], ends])).dictionary_encode()
    n = max(1, len(terms.dictionary))
    langs, sources = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    # once per document and term, then once per group and term
    seen, times = np.unique(row * n + terms.indices.to_numpy(), return_counts=True)
    keys, back = np.unique(group[seen // n] * n + seen % n, return_inverse=True)
    owner, term = keys // n, keys % n
    return [
        langs.dictionary.take(pa.array(owner // len(sources.dictionary))),
        sources.dictionary.take(pa.array(owner % len(sources.dictionary))),
        terms.dictionary.take(pa.array(term)).view(pa.string()),
        pa.array(np.bincount(back, times, len(keys)).astype(np.int64)),
        pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64)),
    ]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""

    def run(batches):
        for piece in common.slices(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays(piece_counts(piece), names=["lang", "source", "term", "n", "docs"])

    made = docs.mapInArrow(run, "lang STRING, source STRING, term STRING, n LONG, docs LONG")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, path): the kept terms with their occurrences in the language and the list of
    (source, n) in the order of sources."""
    rows = term_counts(docs).groupBy("lang", "term")
    path = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("path")
    found = rows.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), path)
    return found.filter(F.col("docs") >= min_docs).drop("docs")


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, n_terms) of every occurring group."""
    by_source = terms.select("lang", F.explode("path").alias("x")).groupBy("lang", F.col("x.source").alias("source"))
    own = by_source.agg(F.sum("x.n").alias("n_group"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("n_terms"))
    groups = docs.select("lang", "source").distinct()
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)


# --- integer shares ---


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 terms)) by long division in base 1000, as the product
    with SCALE need not fit 64 bits."""
    over = total + 2 * terms
    quotient, rest = F.lit(0).cast("long"), count + 2
    for _ in range(round(math.log(SCALE, 1000))):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, over)
        rest = (rest * 1000) % over
    return quotient + 1


def shares(counts: np.ndarray, total: np.ndarray | int, terms: np.ndarray | int) -> np.ndarray:
    """The same over arrays."""
    over = np.maximum(total + 2 * terms, 1)
    quotient, rest = np.zeros(np.shape(counts), np.int64), counts + 2
    for _ in range(round(math.log(SCALE, 1000))):
        quotient, rest = quotient * 1000 + rest * 1000 // over, rest * 1000 % over
    return quotient + 1


def apart(p, q):
    """floor((p - q)^2 / (p + q)), 64 bits being enough as p and q are at most SCALE + 1."""
    return (p - q) * (p - q) // (p + q)


class Groups:
    """The groups of every language: sources in order, their totals and the share of a term they lack."""

    def __init__(self, rows):
        self.langs: dict[str, tuple] = {}
        by_lang: dict[str, list] = {}
        for r in rows:
            by_lang.setdefault(r.lang, []).append(r)
        for lang, own in by_lang.items():
            own.sort(key=lambda r: r.source.encode())
            total = np.array([r.n_group for r in own], np.int64)
            terms = int(own[0].n_terms)
            self.langs[lang] = ([r.source for r in own], total, terms, shares(np.zeros(len(own), np.int64), total, terms))


PAIRS = "lang STRING, a STRING, b STRING, value LONG"


def pair_batch(lang: str, sources: list, a, b, values) -> pa.RecordBatch:
    names = pa.array(sources, pa.string())
    columns = [pa.array([lang] * len(values), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(values)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])


# --- the tree ---


def tree_nodes(at: np.ndarray, counts: np.ndarray, ends: np.ndarray, times: np.ndarray):
    """The tree over sorted rows: row r has the items ends[r] to ends[r + 1] (sources and counts) and stands
    for times[r] terms. Returns for every node its item in the first row that passes it, its depth and
    the terms that pass. An item of a later row with the same beginning is the same node."""
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(len(at)) - ends[row]
    before = np.maximum(row - 1, 0)
    twin = np.minimum(ends[before] + depth, len(at) - 1)
    same = (row > 0) & (depth < sizes[before]) & (at == at[twin]) & (counts == counts[twin])
    shared = np.minimum.reduceat(np.where(same, sizes[row], depth), ends[:-1])
    passed = np.concatenate([[0], np.cumsum(times)])
    nodes, weights = [], []
    for d in range(int(sizes.max())):
        # a node of depth d ends where a row shares at most d items with the row before
        breaks = np.append(np.flatnonzero(shared <= d), len(sizes))
        own = breaks[:-1][sizes[breaks[:-1]] > d]
        nodes.append(ends[own] + d)
        weights.append(passed[breaks[np.searchsorted(breaks, own, "right")]] - passed[own])
    nodes = np.concatenate(nodes)
    return nodes, depth[nodes], np.concatenate(weights)


def ancestor_changes(nodes, depths, weights, at, counts, total, terms, absent):
    """Every node with every ancestor: key of the pair of sources, and what it changes in the pair's sum."""
    p = shares(counts, total[at], terms)
    up = np.repeat(nodes - depths, depths) + np.arange(depths.sum()) - np.repeat(np.cumsum(depths) - depths, depths)
    node = np.repeat(nodes, depths)
    one, other, none, none_up = p[node], p[up], absent[at[node]], absent[at[up]]
    change = apart(one, other) - apart(one, none_up) - apart(none, other) + apart(none, none_up)
    return at[node] * len(absent) + at[up], np.repeat(weights, depths) * change


class PairSums:
    """Sums by pair of sources of one language, passed on when many pairs are held."""

    def __init__(self, lang: str, known: tuple):
        self.lang, (self.sources, self.total, self.terms, self.absent) = lang, known
        self.names = pa.array(self.sources, pa.string())
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, sources: pa.Array, counts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> None:
        """The tree of some sorted rows; its nodes are worked off in stretches of STRETCH ancestors."""
        at = pc.index_in(sources, self.names).to_numpy().astype(np.int64)
        nodes, depths, weights = tree_nodes(at, counts, ends, times)
        stretch = np.cumsum(depths) // STRETCH
        for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(stretch)) + 1):
            keys, values = ancestor_changes(nodes[own], depths[own], weights[own], at, counts, self.total, self.terms, self.absent)
            self.keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            sums = np.zeros(len(self.keys), np.int64)
            np.add.at(sums, back, np.concatenate([self.sums, values]))
            self.sums = sums

    def taken(self):
        """The sums so far, which are then forgotten."""
        if len(self.keys):
            n = len(self.sources)
            yield pair_batch(self.lang, self.sources, self.keys // n, self.keys % n, self.sums)
        self.keys, self.sums = self.keys[:0], self.sums[:0]


def node_corrections(terms: DataFrame, groups) -> DataFrame:
    """The tree's part of every pair's sum, as rows (lang, a, b, value) to be added up."""
    rows = terms.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    laid_out = stored(rows).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def run(batches):
        sums = None
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("path"))
            flat = paths.flatten()
            sources, counts = flat.field("source"), flat.field("n").to_numpy()
            ends = np.concatenate([[0], np.cumsum(paths.value_lengths().to_numpy(), dtype=np.int64)])
            langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
            times = batch.column(batch.schema.get_field_index("times")).to_numpy()
            codes = langs.indices.to_numpy()
            for rows in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1):
                lang, to = langs.dictionary[int(codes[rows[0]])].as_py(), rows[-1] + 1
                if sums is None or sums.lang != lang:
                    if sums is not None:
                        yield from sums.taken()
                    sums = PairSums(lang, groups.value.langs[lang])
                own = slice(int(ends[rows[0]]), int(ends[to]))
                sums.add(sources[own], counts[own], ends[rows[0] : to + 1] - own.start, times[rows[0] : to])
                if len(sums.keys) > HELD:
                    yield from sums.taken()
        if sums is not None:
            yield from sums.taken()

    return laid_out.mapInArrow(run, PAIRS)


def single_corrections(terms: DataFrame, groups) -> DataFrame:
    """What a source's own terms change against every other source that lacks them."""
    rows = terms.select("lang", F.explode("path").alias("x")).groupBy("lang", "x.source", "x.n")
    counted = rows.agg(F.count("*").alias("times"))

    def run(own: pa.Table) -> pa.Table:
        lang, source = own.column("lang")[0].as_py(), own.column("source")[0].as_py()
        sources, total, terms_of, absent = groups.value.langs[lang]
        i = sources.index(source)
        p = shares(own.column("n").to_numpy(), total[i], terms_of)
        sums = -apart(absent[i], absent) * int(own.column("times").to_numpy().sum())
        for one, times in zip(p, own.column("times").to_numpy(), strict=True):
            sums += times * apart(one, absent)
        others = np.flatnonzero(np.arange(len(sources)) != i)
        return pa.Table.from_batches([pair_batch(lang, sources, np.full(len(others), i), others, sums[others])])

    return counted.groupBy("lang", "source").applyInArrow(run, PAIRS)


def absent_sums(groups_table: DataFrame, groups) -> DataFrame:
    """Every ordered pair of sources with the sum it would have if neither held any kept term."""

    def run(batches):
        for batch in batches:
            for lang, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sources, _, terms, absent = groups.value.langs[lang]
                i = sources.index(source)
                others = np.flatnonzero(np.arange(len(sources)) != i)
                values = terms * apart(absent[i], absent[others])
                yield pair_batch(lang, sources, np.full(len(others), i), others, values)

    return groups_table.select("lang", "source").mapInArrow(run, PAIRS)


# --- the audit ---


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part
    `term` the terms that the source uses more than its language, the `top` first of them."""
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    terms = stored(kept_terms(named, min_docs))
    totals = stored(group_totals(named, terms))
    groups = spark.sparkContext.broadcast(Groups(totals.collect()))

    changes = node_corrections(terms, groups).unionByName(single_corrections(terms, groups))
    turned = changes.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    sums = absent_sums(totals, groups).unionByName(changes).unionByName(turned)
    pairs = sums.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))

    held = terms.select("lang", "term", F.col("n").alias("__n"), F.explode("path").alias("__x"))
    held = held.select("lang", "__x.source", "term", "__n", F.col("__x.n").alias("__own"))
    held = salted.join(held, totals, ["lang", "source"], F.xxhash64("term"))
    p = share(F.col("__own"), F.col("n_group"), F.col("n_terms"))
    q = share(F.col("__n"), F.col("n_lang"), F.col("n_terms"))
    held = held.select("lang", "source", F.col("term").alias("item"), p.alias("__p"), q.alias("__q")).filter("__p > __q")
    value = F.expr("(__p - __q) * (__p - __q) div (__p + __q)").alias("value")
    held = held.select("lang", "source", "item", value)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(name))
        for part, name in ((pairs, "pair"), (held, "term"))
    ]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(*columns).unionByName(ranked[1].filter(F.col("rank") <= top).select(*columns))


def op11_divergence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), w AS (
    SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
    SELECT DISTINCT lang, source FROM d
), v AS (
    SELECT lang, sum(n) AS n_lang, count(*) AS n_terms FROM kept GROUP BY lang
), t AS (
    SELECT lang, source, coalesce(sum(n), 0) AS n_group FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), f AS (
    SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS own,
        1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (n_group + 2 * n_terms) AS p,
        1 + ({SCALE}::HUGEINT * (kept.n + 2)) // (n_lang + 2 * n_terms) AS q
    FROM t JOIN kept USING (lang) JOIN v USING (lang)
        LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term
), pairs AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM f AS x JOIN f AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), every AS (
    SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value
    FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pairs AS p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
), rows AS (
    SELECT lang, source, 'pair' AS part, item, value FROM every
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM f WHERE own > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= {TOP}
"""
