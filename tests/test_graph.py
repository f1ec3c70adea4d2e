from collections import defaultdict
from random import Random

import pytest

from siftworks.operators.graph import connected_components, pick_canonical
from siftworks.operators.hierarchy import hierarchy, paths, rank_lists


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "a bigint, b bigint")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_canonical_pick(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 4), (2, 2), (3, 1), (9, 1)], "id bigint, p int")
    found = connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"))
    got = {r["id"]: (r["canon_id"], r["canon_size"]) for r in pick_canonical(rows.select("id", "p"), found, F.col("p")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 3), 9: (9, 1)}


def brute(nodes):
    parents = {}
    for i, ps in nodes:
        if i is not None:
            parents.setdefault(i, set()).update(p for p in ps or [] if p is not None)
    parents = {k: {p for p in v if p in parents} for k, v in parents.items()}

    def above(x):
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents[y]
        return seen

    anc = {x: above(x) for x in parents}
    out = {}
    for x in parents:
        if x in anc[x]:
            out[x] = ("cycle", -1)
        elif any(y in anc[y] for y in anc[x]):
            out[x] = ("below_cycle", -1)
        else:
            def depth(v):
                return 1 + max(map(depth, parents[v])) if parents[v] else 0
            out[x] = ("tree", depth(x))
    return out, anc


CASES = {
    "tree with distant ancestors": [(1, None), (2, [1]), (3, [1, 2]), (4, [2, 3, 1]), (5, [99, None]), (6, [5, 5])],
    "circles": [(1, [2]), (2, [1]), (3, [2]), (4, [3, 5]), (5, []), (6, [6]), (7, [6, 5])],
    "joined circles": [(1, [2]), (2, [1]), (3, [2]), (4, [3, 5]), (5, [4]), (6, [5])],
    "a node that names itself beside circles": [(1, [2]), (2, [1]), (3, []), (4, [3, 4]), (5, [4]), (6, [3])],
    "repeats and nulls": [(1, []), (1, None), (2, [1]), (2, [1]), (None, [1])],
}


def test_hierarchy(spark):
    """All cases in one table, their ids kept apart."""
    shift = lambda i, k: None if i is None else i + 1000 * k
    nodes = [(shift(i, k), ps and [shift(p, k) for p in ps]) for k, case in enumerate(CASES.values()) for i, ps in case]
    found = hierarchy(spark.createDataFrame(nodes, "id bigint, parent_ids array<bigint>")).collect()
    want, _ = brute(nodes)
    assert len(found) == len(want) and {r["id"]: (r["status"], r["depth"]) for r in found} == want


def test_empty_hierarchy(spark):
    assert hierarchy(spark.createDataFrame([], "id bigint, parent_ids array<bigint>")).count() == 0


def test_hierarchy_ignores_other_columns(spark):
    rows = spark.createDataFrame([(1, [2], "x", 9, "y"), (2, None, None, 8, "z")], "id bigint, parent_ids array<bigint>, status string, root_id int, child string")
    assert {(r["id"], r["root_id"], r["status"]) for r in hierarchy(rows).collect()} == {(1, 2, "tree"), (2, 2, "tree")}


def test_long_circle_and_tails(spark):
    nodes = [(i, [(i + 1) % 60]) for i in range(60)] + [(100 + i, [99 + i if i else 3]) for i in range(5)]
    found = {r["id"]: r["status"] for r in hierarchy(spark.createDataFrame(nodes, "id bigint, parent_ids array<bigint>")).collect()}
    assert found == {i: "cycle" if i < 60 else "below_cycle" for i, _ in nodes}


def test_long_chain_and_circle_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 whose nodes name several ancestors, and a circle of 10,000 with a chord."""
    from siftworks.operators import hierarchy as module

    chain = [(i, [j for j in (i - 1, i - 2, 0) if 0 <= j < i]) for i in range(10_000)]
    circle = [(20_000 + i, [20_000 + (i - 1) % 10_000, *([25_000] if i == 0 else [])]) for i in range(10_000)]
    rounds, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda *a, **k: rounds.append(1) or cut(*a, **k))
    found = hierarchy(spark.createDataFrame(chain + circle, "id bigint, parent_ids array<bigint>")).collect()
    want = {i: ("tree", i) for i, _ in chain} | {i: ("cycle", -1) for i, _ in circle}
    assert len(found) == len(want) and {r["id"]: (r["status"], r["depth"]) for r in found} == want
    assert len(rounds) < 150


def test_random_circles(spark):
    rng = Random(8)
    mixed = [(50_000 + 40 * g + i, [50_000 + 40 * g + rng.randrange(40) for _ in range(rng.choice((0, 1, 1, 2)))]) for g in range(12) for i in range(40)]
    found = hierarchy(spark.createDataFrame(mixed, "id bigint, parent_ids array<bigint>")).collect()
    assert len(found) == len(mixed) and {r["id"]: (r["status"], r["depth"]) for r in found} == brute(mixed)[0]


def test_intervals_and_paths(spark):
    rng = Random(5)
    nodes = [(i, [rng.randrange(max(0, i - 9), i)] if i % 40 else []) for i in range(400)]
    tree = hierarchy(spark.createDataFrame(nodes, "id bigint, parent_ids array<bigint>"), direct=100)
    rows = {r["id"]: r for r in tree.collect()}
    _, anc = brute(nodes)
    way = {r["id"]: r["path"] for r in paths(tree, block=50).collect()}
    below = defaultdict(int)
    for x, above in anc.items():
        assert way[x][-1] == x and set(way[x]) - {x} == above and len(way[x]) == rows[x]["depth"] + 1
        for y in above:
            below[y] += 1
            assert rows[y]["entry"] < rows[x]["entry"] < rows[x]["exit"] < rows[y]["exit"]
    assert all(rows[x]["n_descendants"] == below[x] for x in rows)


@pytest.mark.parametrize("direct", [10, 10**6])
def test_list_ranking(spark, direct):
    lists = [(i, i + 1 if i % 70 else None, 1 if i % 2 else -1) for i in range(1, 281)]
    got = {r["e"]: (r["last"], r["steps"], r["weight"]) for r in rank_lists(spark.createDataFrame(lists, "e bigint, next bigint, weight int"), direct, 8).collect()}
    nxt, w = {e: n for e, n, _ in lists}, {e: v for e, _, v in lists}
    for e in nxt:
        steps, total, x = 0, w[e], e
        while nxt[x] is not None:
            x = nxt[x]
            steps, total = steps + 1, total + w[x]
        assert got[e] == (x, steps, total)
