"""Memory of counting terms."""

import random
import tracemalloc

import pyarrow as pa
import pytest

pytest.importorskip("normspark.llm")

from normspark.llm import common, divergence  # noqa: E402


def test_counting_terms_holds_little_memory():
    """A piece of text is counted with a few times its size, not with all of a batch at once."""
    r = random.Random(3)
    known = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    texts = [" ".join(r.choices(known, k=1000)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(["en"] * len(texts)), pa.array(["s"] * len(texts))], names=["text", "lang", "source"]
    )
    tracemalloc.start()
    n = 0
    for piece in common.slices([batch], "text", divergence.PIECE):
        n += sum(divergence.piece_counts(piece)[3].to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len(t.split()) for t in texts)
    assert peak < 150 << 20
