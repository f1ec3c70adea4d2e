from random import Random

import pytest

from siftworks.llm.components import components, consolidate


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


CASES = {
    "chain": [(i, i + 1) for i in range(70)],
    "chain backwards": [(i + 1, i) for i in range(70, 0, -1)],
    "star": [(0, i) for i in range(1, 200)],
    "random": [(a := Random(i).randrange(400), (a + 1 + Random(-i).randrange(398)) % 400) for i in range(1, 320)],
    "repeats in either direction": [(1, 2), (2, 1), (1, 2), (5, 4), (4, 5)],
    "negative": [(-5, 3), (3, 9), (-7, -8)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    rows = [*CASES[name], (None, 1), (1, None), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "left bigint, right bigint")).collect()}
    assert got == union_find(CASES[name])


def test_empty(spark):
    assert components(spark.createDataFrame([], "left bigint, right bigint")).collect() == []


def test_consolidate(spark):
    records = spark.createDataFrame([(i, 9, "x") for i in (1, 2, 3, 4, 5, 5, None)], "id bigint, canon_id bigint, left_id string")
    matches = spark.createDataFrame(
        [(1, 2, True, "a"), (2, 1, True, "b"), (2, 3, True, None), (3, 4, False, None), (4, 5, None, None), (5, 99, True, None), (None, 1, True, None), (4, 4, True, None)], "left_id bigint, right_id bigint, is_match boolean, id string"
    )
    got = sorted(tuple(r) for r in consolidate(records, matches).collect())
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert consolidate(records.limit(0), matches).count() == 0 and consolidate(records, matches.limit(0)).count() == 0
