from hypothesis import given, settings
from hypothesis import strategies as st

from siftworks.llm.mix import mix, quotas, sainte_lague, shard_quotas


def slow(weights, seats):
    from fractions import Fraction

    out = dict.fromkeys(weights, 0)
    live = {k: Fraction(w) for k, w in weights.items() if w > 0}
    for _ in range(seats if live else 0):
        best = min(live, key=lambda k: (-live[k] / (2 * out[k] + 1), k))
        out[best] += 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(0, 40), max_size=6), st.integers(0, 300))
def test_sainte_lague(weights, seats):
    assert sainte_lague(weights, seats) == slow(weights, seats)


def test_many_keys_take_seconds():
    import time

    began = time.perf_counter()
    out = sainte_lague({k: 1000 + k % 17 for k in range(10_000)}, 70_001)
    assert sum(out.values()) == 70_001 and max(out.values()) - min(out.values()) <= 1 and time.perf_counter() - began < 20


def test_shard_quotas_are_those_of_the_method(spark):
    weights = {"a": {0: 70, 1: 71, 2: 500, 3: 3}, "b": {0: 9, 1: 9, 2: 9}, "c": {0: 40}}
    seats = {"a": 37, "b": 1, "c": 0}
    per = spark.createDataFrame([(s, k, n) for s, own in weights.items() for k, n in own.items()], "_source string, shard bigint, n bigint")
    got = {(r["_source"], r["shard"]): r["quota"] for r in shard_quotas(per, spark.createDataFrame(list(seats.items()), "_source string, seats bigint")).collect()}
    assert got == {(s, k): n for s, own in weights.items() for k, n in slow(own, seats[s]).items()}


def test_quotas_respect_caps():
    # by hand: c has no tokens, so a and b share 5 to 4; b may fill 100 * 2 / 10 = 20 blocks, which go with 25 of a
    given_, total = quotas({"a": 1000, "b": 100, "x": 5}, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 3)}, 10)
    assert given_["a"] <= 100 and given_["b"] <= 20 and "c" not in given_ and total == sum(given_.values()) == 45
    given_, _ = quotas({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}, 10, total=1100)
    assert given_ == {"b": 20, "a": 90}


def test_mix(spark):
    rows = [(i, "big", 10) for i in range(500)] + [(1000 + i, "small", 10) for i in range(30)] + [(2000, None, 10), (2001, "other", 10), (2002, "big", None), (2003, "big", 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, source string, n_tokens bigint, uses int, shard string")  # names the operator uses too
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, report = mix(docs, targets, block=10, shard_tokens=1000)
    uses = {r["doc_id"]: r["uses"] for r in used.collect()}
    assert all(u <= (1 if k < 1000 else 3) for k, u in uses.items()) and not {2000, 2001, 2002, 2003} & set(uses)
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["big"]["actual_share"] - 2 / 3) < 0.02 and abs(shares["small"]["actual_share"] - 1 / 3) < 0.02 and shares["none"]["documents"] == 0
    assert shares["small"]["most_uses"] == 3
    again, _ = mix(docs.repartition(7), targets, block=10, shard_tokens=1000)
    assert {r["doc_id"]: r["uses"] for r in again.collect()} == uses
    empty, report = mix(docs.limit(0), targets)
    assert empty.count() == 0 and report.count() == 3


def test_a_source_smaller_than_a_block_does_not_empty_the_mix(spark):
    rows = [(i, "big", 10) for i in range(500)] + [(1000 + i, "tiny", 10) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, report = mix(docs, targets)
    shares = {r["source"]: r for r in report.collect()}
    assert (shares["tiny"]["mixed_tokens"], shares["big"]["mixed_tokens"]) == (60, 540)
    assert (shares["tiny"]["actual_share"], shares["big"]["actual_share"]) == (0.1, 0.9)
    assert used.count() == 57
