"""Divergence of sources against sums over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

divergence = pytest.importorskip("normspark.llm.divergence")

KIND = "doc_id LONG, text STRING, lang STRING, source STRING, value STRING, rank STRING"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcÄé漢Z") for _ in range(r.randint(1, 3))) for _ in range(60)]
    out = []
    for i in range(400):
        source = r.choice(["s1", "s2", "s10", "é", None, "s1", "s1"])
        lang = r.choice(["en", "en", "de", None])
        own = vocabulary[: 20 + 8 * len(source or "")]
        out.append((i, r.choice([" ", "-1", "\n"]).join(r.choice(own) for _ in range(r.randint(0, 60))), lang, source))
    out += [(900 + i, "same ROW row", "xx", "only") for i in range(12)] + [(912, None, "xx", "none"), (913, "", None, None)]
    out += [(920, "few terms", "yy", "a"), (921, "", "yy", "b"), (922, "common " * 30000 + "x" * 70000, "en", "s1")]
    return out + out[:3]


ROWS = rows()


def brute(rows, min_docs=10, top=10):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        held[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        count = {s: {t: held[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def share(counts):
            n = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c + 2) // n for t, c in counts.items()}

        p = {s: share(count[s]) for s in sources}
        q = share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", o, -v, i) for i, (v, _, o) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND).repartition(5)


def test_audit(spark):
    assert got(frame(spark, ROWS)) == brute(ROWS)


def test_other_limits(spark):
    assert got(frame(spark, ROWS), min_docs=1, top=3) == brute(ROWS, 1, 3)


def test_small_pieces_and_early_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 2000)
    monkeypatch.setattr(divergence, "HELD", 8)
    monkeypatch.setattr(divergence, "STRETCH", 50)
    assert got(frame(spark, ROWS)) == brute(ROWS)


def test_nodes_are_shared():
    """Rows with the same beginning share its nodes."""
    np = divergence.np
    paths = [[(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 1)], [(0, 1), (1, 2), (2, 4)], [(0, 2), (1, 2)], [(1, 1), (2, 9)]]
    flat = np.array([x for path in paths for x in path])
    ends = np.cumsum([0, *map(len, paths)])
    nodes, depths, weights = divergence.tree_nodes(flat[:, 0], flat[:, 1], ends, np.array([3, 1, 2, 5, 1]))
    made = sorted((int(d), int(flat[n, 0]), int(flat[n, 1]), int(w)) for n, d, w in zip(nodes, depths, weights, strict=True))
    assert made == [(0, 0, 1, 6), (0, 0, 2, 5), (0, 1, 1, 1), (1, 1, 2, 5), (1, 1, 2, 6), (1, 2, 9, 1), (2, 2, 1, 1), (2, 2, 4, 2)]


def test_large_counts_stay_exact():
    import numpy as np

    counts, total = [3, 10**13, 8 * 10**15], 9 * 10**15
    made = divergence.shares(np.array(counts), np.int64(total), np.int64(7))
    assert made.tolist() == [1 + 10**9 * (c + 2) // (total + 14) for c in counts]


def test_empty(spark):
    assert got(frame(spark, [(1, "a", "en", "s")]).limit(0)) == []
    assert got(frame(spark, [(1, None, None, None)])) == []
