"""Packing of large groups against a plain search over all sequences."""

import random

import pytest

pytest.importorskip("normspark.llm")

from normspark.llm import packing  # noqa: E402


def plain(lengths, length):
    """Pieces of full sequences, and how often a document was cut."""
    full = sum(lengths) // length
    pieces, waiting, cuts = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // length
        pieces += [(d, k * length, length, len(pieces) + k, 0) for k in range(whole)]
        if n % length:
            waiting.append((-(n % length), d, whole * length))
    room = {s: length for s in range(len(pieces), full)}
    spent = dict.fromkeys(room, 0.0)
    while waiting and room:
        waiting.sort()
        less, d, start = waiting.pop(0)
        n = -less
        s = min([x for x in room if room[x] >= n] or room, key=lambda x: (spent[x], x))
        take = min(n, room[s])
        pieces.append((d, start, take, s, length - room[s]))
        spent[s] += packing.cost(take, length)
        room[s] -= take
        if not room[s]:
            del room[s]
        if take < n:
            cuts += 1
            waiting.append((take - n, d, start + take))
    return pieces, cuts


@pytest.mark.parametrize("mean", [4.0, 5.5, 6.5])
def test_large_group(mean):
    r = random.Random(int(mean * 10))
    lengths = [1 + int(r.lognormvariate(mean, 1.0)) for _ in range(int(400 * 1024 / 2.7183 ** (mean + 0.5)))]
    want, cuts = plain(lengths, 1024)
    got = packing.pack(lengths, 1024)
    full = sum(lengths) // 1024
    assert full > 300 and cuts
    assert [p for p in got if p[3] < full] == want
    held = {}
    for d, start, n, _, _ in got:
        held.setdefault(d, []).append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(held[d]):
            assert start == at
            at += size
        assert at == n


def test_odd_groups():
    assert packing.pack([], 8) == []
    assert packing.pack([3], 8) == [(0, 0, 2, 0, 0), (0, 2, 1, 1, 0)]
    assert packing.pack([8, 16], 8) == [(0, 0, 8, 0, 0), (1, 0, 8, 1, 0), (1, 8, 8, 2, 0)]
