"""Language identification against a plain version; many languages, copies and long texts."""

import math
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("normspark.llm")

from normspark.llm import ppm  # noqa: E402

KIND = "text STRING, lang STRING"


def prose(letters, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(30)]
    return " ".join(r.choice(words) for _ in range(n))


def trees(texts):
    """context -> counts of the byte after it."""
    out = defaultdict(Counter)
    for data in {t.encode() for t in texts}:
        for i, byte in enumerate(data):
            for d in range(min(i, ppm.ORDER) + 1):
                out[data[i - d : i]][byte] += 1
    return out


def code_length(tree, text):
    total, data = 0.0, text.encode()
    for i, byte in enumerate(data):
        for d in range(min(i, ppm.ORDER), -1, -1):
            after = tree.get(data[i - d : i])
            if after is None:
                continue
            base = after.total() + len(after)
            if byte in after:
                total -= math.log2(after[byte] / base)
                break
            total -= math.log2(len(after) / base)
        else:
            total += 8
    return total


def plain(labelled, texts):
    own = defaultdict(list)
    for text, lang in labelled:
        own[lang].append(text)
    known = {k: trees(v) for k, v in sorted(own.items())}
    for text in texts:
        bits = {k: code_length(t, text) for k, t in known.items()}
        best = min(bits, key=bits.get)
        yield best, 1 / sum(math.exp((bits[best] - b) * math.log(2) / ppm.TEMPERATURE) for b in bits.values())


def predicted(spark, labelled, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    model = ppm.train(spark.createDataFrame(labelled, KIND).repartition(3))
    return [(r.lang_pred, r.score) for r in sorted(ppm.predict(docs, model).collect())]


def test_plain_version(spark):
    labelled = [(prose(a, 120, 3 * i + j), a) for i, a in enumerate(["abcde", "abcdf", "éßab", "漢字ab"]) for j in range(3)]
    labelled += [("q", "short"), ("xy", "short")] + labelled[:2] * 2
    texts = [prose(a, n, 50 + n) for a in ("abcde", "abcdf", "éßab", "漢字ab", "xyz") for n in (1, 2, 40)] + ["x", "q"]
    for (lang, score), (want, chance) in zip(predicted(spark, labelled, texts), plain(labelled, texts), strict=True):
        assert lang == want and score == pytest.approx(chance, rel=1e-3)


def test_every_language_is_learned(spark):
    labelled = [(prose("abcdefghij", 60, k), f"l{k:03d}") for k in range(300)]
    texts = [" ".join(reversed(t.split())) for t, _ in labelled]
    assert [lang for lang, _ in predicted(spark, labelled, texts)] == [lang for _, lang in labelled]


def test_copies_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "SAMPLE", 2)
    many = [(f"the cat and the hat {i}", "en") for i in range(3)]
    copied = [("der hund und das haus", "de")] * 400 + [("il gatto e la casa", "it")] * 400
    tail = prose("uvwxyz", 400, 1)
    labelled = many + copied + [("1 " * 3000 + tail, "long"), ("9 " * 3000, "nine")]
    texts = ["der hund und das haus", "il gatto e la casa", "the cat and the hat", tail]
    assert [lang for lang, _ in predicted(spark, labelled, texts)] == ["de", "it", "en", "long"]


def test_budget_is_a_languages_own(spark, monkeypatch):
    large = [(prose("abcdefghijklmnop", 900, k), "large") for k in range(8)]
    small = [(prose("qrstu", 15, 1), "small"), (prose("vwxyz", 15, 2), "rare")]
    monkeypatch.setattr(ppm, "GRAMS", 400)
    model = ppm.train(spark.createDataFrame(large + small, KIND))
    held = dict(zip(model.langs, model.trees, strict=True))
    assert 0 < len(held["large"].grams) <= 400
    for text, lang in small:
        assert len(held[lang].grams) == sum(len(x) for x in trees([text]).values()) <= 400
    order = held["large"].contexts >> ppm.CODE
    assert (order == 0).sum() == 1 and order.max() >= 1
