"""All stages of the pipeline against plain versions; repeated and null doc_ids."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("normspark.llm")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from normspark.llm import minhash  # noqa: E402

KIND = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def prose(seed, n, letters="abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n)]


def laid(words, width):
    """Lines of this many words: other widths give other lines and the same shingles."""
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def table():
    base, other, bridge = prose(1, 200), prose(2, 200), prose(3, 300)
    line, passage = " ".join(prose(4, 20)), prose(5, 50)
    rows = [(1, laid(base, 23)), (5, laid(base, 17)), (5, laid(prose(6, 60), 9)), (None, laid(base, 31))]
    rows += [(2, laid(other, 23)), (3, laid(other[:180] + prose(7, 20), 17)), (4, laid(other[:130] + prose(8, 70), 13))]
    # 6 and 7 are linked by a text without a doc_id only
    rows += [(6, laid(bridge[:260], 23)), (7, laid(bridge[35:], 17)), (None, laid(bridge[:290], 31))]
    rows += [(10 + k, "\n".join([laid(prose(20 + k, 30), 11), line, laid(prose(40 + k, 30), 11)])) for k in range(4)]
    rows += [(20 + k, laid(prose(60 + k, 40) + passage + prose(80 + k, 40), 13 + 4 * k)) for k in range(3)]
    rows += [(30 + k, laid(prose(100 + k, 60, "αβγδεζη漢字"), 10)) for k in range(6)]
    rows += [(40, None), (41, ""), (42, "12 34"), (43, "x"), (None, None), (None, laid(prose(120, 50), 10)), (44, laid(prose(110, 9000), 15))]
    rows = [(i, t, "el" if t and "α" in t else "en", "s", len(t or "")) for i, t in rows]
    return rows + [(50, laid(prose(9, 50), 10), None, None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(sets, percent):
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = root[b], root[a]
                root = [new if x == old else x for x in root]
    return root


def plain_lines(rows):
    found = []
    for i, (doc, text, *_) in enumerate(rows):
        for n, x in enumerate(text.split("\n")):
            if words(x):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), x)
                shingles = frozenset(low[j : j + 5] for j in range(len(low) - 4)) or frozenset([low])
                found.append(((doc is not None, doc or 0), i, n, shingles))
    found.sort(key=lambda f: f[:3])
    sets = list(dict.fromkeys(f[3] for f in found))
    of = dict(zip(sets, components(sets, 80), strict=True))
    gone, seen = set(), set()
    for _, i, n, s in found:
        gone |= {(i, n)} & ({(i, n)} if of[s] in seen else set())
        seen.add(of[s])
    for i, (doc, text, lang, source, _) in enumerate(rows):
        left = [x for n, x in enumerate(text.split("\n")) if (i, n) not in gone]
        text = "\n".join(left) if any(map(words, left)) or len(left) == text.count("\n") + 1 else ""
        yield doc, text, lang, source, len(text)


def plain_near(rows):
    sets = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    of = components(sets, 80)
    for i, r in enumerate(rows):
        ids = [x[0] for x, o in zip(rows, of, strict=True) if o == of[i] and x[0] is not None]
        if not ids or r[0] == min(ids):
            yield r


def plain_substrings(rows, size=35):
    count = Counter(tuple(w[j : j + size]) for r in rows for w in [words(r[1])] for j in range(len(w) - size + 1))
    for doc, text, lang, source, _ in rows:
        w = words(text)
        gone = {j + k for j in range(len(w) - size + 1) if count[tuple(w[j : j + size])] > 1 for k in range(size)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield doc, text, lang, source, len(text)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages(spark):
    rows = table()
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        return ordered(stages[name](spark, spark.createDataFrame(rows, KIND).repartition(3), "").collect())

    named = run("language_id", rows)
    assert named == ordered(r for r in rows if re.search(r"[^\W\d_]", r[1] or ""))
    lined = run("line_dedup", named)
    assert lined == ordered(plain_lines(named)) and lined != named
    near = run("minhash_near_dedup", lined)
    assert near == ordered(plain_near(lined)) and {r[0] for r in lined} - {r[0] for r in near} == {3, 7}
    assert [r[0] for r in near].count(5) == [r[0] for r in near].count(None) == 1
    cut = run("substring_dedup", near)
    assert cut == ordered(plain_substrings(near)) and cut != near
    own = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in cut:
        ids[r[0]].append(np.array([*own.encode(r[1], add_special_tokens=False).ids, 2], np.uint32))
    pieces, sequences = Counter(), defaultdict(list)
    for r in stages["packing"](spark, spark.createDataFrame(cut, KIND), "").collect():
        parts = [x[r.start : r.start + r.length] for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(x.tobytes()) for x in parts if len(x) == r.length]
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
    for own_pieces in sequences.values():
        at = 0
        for offset, n in sorted(own_pieces):
            assert offset == at
            at += n
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], KIND), "").count() == 0, name


def test_rows_that_share_a_doc_id(spark):
    rows = [r for r in table() if r[1]]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found = minhash.near_duplicates(docs, 80).filter("kept").select(*docs.columns).collect()
    assert ordered(found) == ordered(plain_near(rows))
