from collections import defaultdict
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftworks.llm.pack import pack


def swept(line, sizes):
    """The line cut into partitions of the given sizes, swept and matched across: item -> bin."""
    import pandas as pd

    from siftworks.llm.pack import across, sweep

    found, left, items, gaps, at = {}, [], {}, {}, 0
    for p, n in enumerate(sizes):
        part = pd.DataFrame([(p, *x) for x in line[at : at + n]], columns=["p", "kind", "key", "size", "used"])
        at += n
        a = b = 0
        for frame in sweep(iter([part])):
            for r in frame.itertuples():
                if r.kind and not pd.isna(r.bin):
                    found[r.key] = r.bin
                elif r.kind:
                    items[p, r.nth], a = r.key, a + 1
                else:
                    gaps[p, r.nth], b = r.key, b + 1
        left.append((p, a, b))
    for p, first, many, q, top in across(left):
        for k in range(many):
            found[items[p, first + k]] = gaps[q, top - k]
    return found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 30)), max_size=60), st.lists(st.integers(0, 20), min_size=1, max_size=6))
def test_sweeps_match_alike_in_any_partitions(things, cuts):
    line = sorted([(kind, k, size, 0) for k, (kind, size) in enumerate(things)], key=lambda x: (-x[2], x[0], x[1]))
    got = swept(line, [*cuts, 60])
    assert got == swept(line, [len(line)])
    size = {k: s for _, k, s, _ in line}
    assert len(set(got.values())) == len(got) and all(size[i] <= size[g] for i, g in got.items())


def test_pack_is_the_same_in_any_partitions(spark):
    """Divided items too: twelve of 250 to 261 with a capacity of 100."""
    docs = spark.createDataFrame([*((i, 250 + i) for i in range(12)), *((100 + i, i % 37) for i in range(150))], "doc_id bigint, n_tokens bigint")
    rows = lambda df: sorted(map(tuple, pack(df, 100).collect()))
    assert rows(docs.repartition(1)) == rows(docs.repartition(7, "n_tokens"))


def test_pack(spark):
    rng = Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000]), i) for i in range(400)] + [(400, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container int")
    got = pack(docs, 100).collect()
    used, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        used[r["container"]].append((r["offset"], r["size"]))
        pieces[r["doc_id"]].append((r["piece_no"], r["start_token"], r["size"]))
    for spans in used.values():
        at = 0
        for offset, size in sorted(s for s in spans if s[1]):
            assert offset == at
            at += size
        assert at <= 100
    for key, size, _ in rows:
        mine = sorted(pieces[key])
        assert [p for p, _, _ in mine] == list(range(len(mine))) and sum(s for _, _, s in mine) == (size or 0)
        assert len(mine) == max(1, -(-(size or 0) // 100))
    total = sum(s or 0 for _, s, _ in rows)
    assert len(used) <= -(-total // 100) * 1.01 + 2  # items of 99 leave a token no item fits
    assert pack(docs.limit(0), 100).count() == 0


def test_negative_size_is_refused(spark):
    with pytest.raises(Exception, match="assert|ASSERT|true"):
        pack(spark.createDataFrame([(1, -1)], "doc_id bigint, n_tokens bigint"), 10).collect()
