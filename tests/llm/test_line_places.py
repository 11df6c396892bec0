"""Places at which the lines of large keys are compared, found on rows without texts."""

import random
from itertools import combinations

import pytest

pytest.importorskip("public_tokenizers")

from normspark.llm import common as c
from normspark.llm import lines


def test_lines_of_other_components_meet_without_their_texts(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 6)  # keys have several parts
    some = random.Random(7)
    keys = {k: some.sample(range(60), 25) for k in range(1, 6)}
    component = {i: i % 4 for i in range(40)}  # the others have no link yet
    large = {}
    for k, ids in keys.items():
        for i in ids:
            large.setdefault(i, []).append((k, 5))
    large = spark.createDataFrame(list(large.items()), "id LONG, keys ARRAY<STRUCT<key: LONG, parts: INT>>")
    sizes = spark.createDataFrame([(i, 10) for i in range(60)], "id LONG, bytes INT")
    found = spark.createDataFrame(list(component.items()), "id LONG, component LONG")
    places = lines.across_parts(large, sizes, found)
    assert places.columns == ["id", "component", "places"]
    rows = {r["id"]: r for r in places.collect()}
    assert {i: r["component"] for i, r in rows.items()} == {i: component.get(i, i) for i in rows}
    at = {i: {(p["key"], p["x"], p["y"], p["role"]) for p in r["places"]} for i, r in rows.items()}
    for k, ids in keys.items():
        for a, b in combinations(ids, 2):
            if component.get(a, a) != component.get(b, b):
                meet = [(x, y) for (q, x, y, role) in at[a] if q == k and (k, x, y, 1 - role) in at[b]]
                assert meet, (k, a, b)


def test_components_go_on_from_stars(spark):
    edges = spark.createDataFrame([*combinations(range(5, 25), 2), (30, 31)], "a LONG, b LONG")
    found = c.components(edges).collect()
    stars = c.stars(spark.createDataFrame(found, "id LONG, component LONG"))
    assert stars.count() == 22 < edges.count()
    more = spark.createDataFrame([(24, 31)], "a LONG, b LONG")
    joined = {tuple(r) for r in c.components(stars.unionByName(more)).collect()}
    assert joined == {(i, 5) for i in (*range(5, 25), 30, 31)}
