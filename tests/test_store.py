from pyspark.sql import functions as F

from siftworks.operators import store


def test_upsert_takes_the_last_and_joins_nulls(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id int, k string, v string")
    new = spark.createDataFrame([(3, "a", "z"), (4, "a", "w"), (5, None, "n"), (6, "b", "q")], "id int, k string, v string")
    got = {tuple(r) for r in store.upsert(old, new, ["k"], [F.col("id")]).collect()}
    assert got == {(4, "a", "w"), (5, None, "n"), (6, "b", "q")}


def test_insert_ignore_keeps_the_first(spark):
    old = spark.createDataFrame([(1, "a")], "id int, k string")
    new = spark.createDataFrame([(2, "a"), (4, "b"), (3, "b")], "id int, k string")
    assert {tuple(r) for r in store.insert_ignore(old, new, ["k"], [F.col("id")]).collect()} == {(1, "a"), (3, "b")}


def test_get_or_create_numbers_on(spark):
    dim = spark.createDataFrame([(7, "b")], "id bigint, name string")
    names = spark.createDataFrame([("c",), ("a",), ("b",), (None,), ("c",)], "name string")
    assert {tuple(r) for r in store.get_or_create(dim, names, "name", "id").collect()} == {(7, "b"), (8, "a"), (9, "c")}


def test_coalesce_update(spark):
    old = spark.createDataFrame([(1, "x"), (2, None)], "id int, d string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "q")], "id int, d string")
    assert {tuple(r) for r in store.coalesce_update(old, new, "id", ["d"]).collect()} == {(1, "x"), (2, "")}


def test_cache(spark):
    rows = spark.sql("select * from values ('a', 'r', timestamp'2024-01-02 00:00:00', 5, 3), ('a', 's', timestamp'2024-01-02 01:00:00', 5, 9), ('b', '', timestamp'2024-01-02 01:00:00', 5, 8), ('c', 't', timestamp'2023-01-01 00:00:00', 7, 7) as t(cache_key, result, created_at, size, used_at)")
    live = store.cache_live(rows, F.expr("timestamp'2024-01-02 12:00:00'")).select("cache_key", "result").collect()
    assert [tuple(r) for r in live] == [("a", "s")]
    within = store.cache_within(rows, 10).select("cache_key", "running").collect()
    assert sorted(tuple(r) for r in within) == [("a", 5), ("b", 10)]
