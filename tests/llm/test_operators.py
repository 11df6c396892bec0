"""Text operators against plain versions on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("normspark.llm")
P = pytest.importorskip("public_tokenizers")

from normspark.llm import bpe, lines, minhash, packing, relative_lz, repetition, run_index, subspace  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sample():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, line = prose(60), prose(40)
    near = prose(300).split()
    rows = [None, "", " \t\n ", "one two", "a b c d e", "  x\n\n y  ", line, passage, passage]
    rows += [prose(50) + " " + passage + "\n" + prose(30) for _ in range(4)]
    rows += [prose(20) + "\n" + line + "\n" + prose(20) for _ in range(4)]
    rows += [" ".join([*near[:i], "changed", *near[i + 1 :]]) for i in (3, 100, 200)]
    rows += [prose(12) + "\n" + prose(12)] * 3
    rows += ["rep eat " * 300, "z" * 3000, prose(8000), prose(30) + " " + line + " " + line]
    return list(enumerate(rows)) + [(6, line)]  # a repeated row


ROWS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, "clash", 7, -1) for i, t in ROWS]
    kind = "doc_id LONG, text STRING, kept STRING, n_words INT, component_id INT"
    return spark.createDataFrame(made, kind).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id LONG, text STRING")


def words(text):
    return WORD.findall((text or "").encode())


def cover(flags, width, n):
    out = np.zeros(n, bool)
    for i in flags:
        out[i : i + width] = True
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_relative_lz(docs, none):
    size = relative_lz.WINDOW
    count = Counter(tuple(w[j : j + size]) for _, t in ROWS for w in [words(t)] for j in range(len(w) - size + 1))
    want = []
    for i, t in ROWS:
        w = words(t)
        gone = cover([j for j in range(len(w) - size + 1) if count[tuple(w[j : j + size])] > 1], size, len(w))
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        want.append((i, len(w), int(gone.sum()), kept))
    got = relative_lz.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "text")
    assert rows_of(got) == sorted(want)
    assert relative_lz.substring_dedup(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_run_index(docs, none, hot, monkeypatch):
    if hot:  # every anchor goes through the exchange of fingerprints
        monkeypatch.setattr(run_index, "GROUP_BYTES", 0)
    size = run_index.LENGTH
    count = Counter(b[j : j + size] for _, t in ROWS for b in [(t or "").encode()] for j in range(len(b) - size + 1))
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = cover([j for j in range(len(b) - size + 1) if count[b[j : j + size]] > 1], size, len(b))
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = run_index.substring_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [(*r[:4], bytes(r[4])) for r in rows_of(got)] == sorted(want)
    if not hot:
        assert run_index.substring_dedup(none).count() == 0


def test_repetition(docs, none):
    want = []
    for i, t in ROWS:
        w = words(t)

        def covered(m, w=w):
            seen = Counter(tuple(w[j : j + m]) for j in range(len(w) - m + 1))
            return int(cover([j for j in range(len(w) - m + 1) if seen[tuple(w[j : j + m])] > 1], m, len(w)).sum())

        some = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
        five = covered(5)
        failed = len(w) < 10 or 100 * five > 20 * len(w)
        long = covered(repetition.MOST_REPEAT + 1) > 0
        kept = not failed and covered(repetition.MIN_WORDS) <= repetition.MOST_COVERED * len(w) and not long
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(some) - len(set(some)), five, failed, kept))
    got = repetition.repetition_rules(docs, keep=["doc_id"])
    got = got.select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(got) == sorted(want)
    assert repetition.repetition_rules(none).count() == 0


def test_bpe(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.encode_documents(docs, path, P.PATTERN, ["doc_id"]).collect()
    want = sorted((i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS)
    assert sorted((r[0], np.frombuffer(r[2], "<u4").tolist(), bytes(r[3])) for r in got) == want
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0
    coder = bpe.coder(path, P.PATTERN)
    for text in ("a  b", "a   b \n c", "\n x", "  a  b", "a'll 's", "wo" * 200 + " end"):
        assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_packing(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in ROWS}
    got = packing.pack_documents(docs, path).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32)
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r.length)
    for own_pieces in sequences.values():
        at = 0
        for offset, n in sorted(own_pieces):
            assert offset == at
            at += n
        assert at == packing.LENGTH or at & (at - 1) == 0
    repeats = Counter(i for i, _ in ROWS)
    assert {i: sum(v) for i, v in pieces.items()} == {i: n * len(ids[i]) for i, n in repeats.items()}
    assert packing.pack_documents(none, path).count() == 0


def test_run_index_with_a_passage_twice_in_one_string(spark):
    """A gram that stands twice in the same strings is no second place of them."""
    r = np.random.default_rng(11)
    letters = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    rows = []
    for i in range(40):
        passage = letters(130)
        rows.append((i, letters(200) + passage + letters(20) + passage + letters(200)))
    got = run_index.substring_dedup(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert {(x.n_removed, x.n_spans) for x in got.collect()} == {(0, 0)}


def components(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_minhash(docs, none):
    sets = {}
    for i, t in ROWS:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    of = components(links, sets)
    want = sorted((i, len(sets[i]), of[i], of[i] == i) for i, _ in ROWS)
    got = minhash.near_duplicates(docs, keep=["doc_id"])
    assert rows_of(got.select("doc_id", "n_shingles", "component_id", "kept")) == want
    assert minhash.near_duplicates(none).count() == 0


def test_lines(docs, none):
    def shingles(x):
        x = re.sub("[A-Z]", lambda m: m[0].lower(), x)
        return frozenset(x[j : j + 5] for j in range(len(x) - 4)) or frozenset([x])

    found = []
    for order, (i, t) in enumerate(sorted(ROWS, key=lambda r: r[0])):
        own = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
        found += [(i, order, n, shingles(x)) for n, x in enumerate(own)]
    sets = list(dict.fromkeys(s for *_, s in found))
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = components(links, range(len(sets)))
    number, seen, gone, total = {s: k for k, s in enumerate(sets)}, set(), Counter(), Counter()
    for i, _, _, s in found:
        total[i] += 1
        gone[i] += of[number[s]] in seen
        seen.add(of[number[s]])
    got = defaultdict(lambda: [0, 0])
    for r in lines.line_dedup(docs).collect():
        got[r.doc_id][0] += r.n_lines
        got[r.doc_id][1] += r.n_removed
    assert dict(got) == {i: [total[i], gone[i]] for i, _ in ROWS}
    assert lines.line_dedup(none).count() == 0
    # copies inside one text, blank lines between them, and a column named like a result
    one = none.sparkSession.createDataFrame(
        [(1, "same line\n\nsame line\nother words here", "x")], "doc_id LONG, text STRING, N_LINES STRING"
    )
    (row,) = lines.line_dedup(one).collect()
    assert (row.text, row.n_lines, row.n_removed) == ("same line\n\nother words here", 3, 1)


def test_lines_of_keys_with_several_parts(spark, monkeypatch):
    """Keys whose lines are dealt into parts give the same lines as keys of one part."""
    r = np.random.default_rng(5)
    texts = []
    for _ in range(6):  # near copies of the same lines, some of them just below the limit
        base = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), 120))
        for _ in range(40):
            at = r.choice(120, int(r.integers(0, 7)), replace=False)
            texts.append("".join("#" if k in at else x for k, x in enumerate(base)))
    shingles = [{t[j : j + 5] for j in range(len(t) - 4)} for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    of = components(links, range(len(texts)))
    assert 6 < len(set(of.values())) < len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = {i for i in of if of[i] != i}
    for block in (512, 5):
        monkeypatch.setattr(lines, "BLOCK", block)
        got = {x.doc_id for x in lines.line_dedup(frame).filter("n_removed > 0").collect()}
        assert got == want


def test_subspace(spark):
    random_ = np.random.default_rng(3)
    base = random_.normal(size=(20, 64))
    vectors = [*base, *(base + random_.normal(scale=0.08, size=base.shape)), *base[:5]]
    rows = [(i, [float(x) for x in np.float32(v)], i % 2 if i % 7 else 0) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0]]
    rows += [(100 + k, v, 0) for k, v in enumerate(odd)] + [(200, rows[0][1], None)]
    x = {i: np.array(v) for i, v, label in rows if i < 100}
    label = {i: y for i, _, y in rows}
    links = [
        (a, b)
        for a in x
        for b in x
        if a < b and label[a] == label[b] and x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b]) >= 0.98
    ]
    assert links
    of = components(links, [r[0] for r in rows])
    count = Counter(i for pair in links for i in pair)
    want = sorted((i, count[i], of[i], of[i] == i) for i, _, _ in rows)
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    assert rows_of(subspace.near_duplicates(frame)) == want
    assert subspace.near_duplicates(frame.limit(0)).count() == 0
