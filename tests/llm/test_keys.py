import numpy as np
from pyspark.sql import functions as F

from siftworks.llm.canonical import canonical_countries
from siftworks.llm.variants import left_out, person_pairs, ranked_pairs


def _written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _written_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_words_a_letter_apart_share_a_key(spark):
    rng = np.random.default_rng(3)
    words = ["", "a", "ab", "ba", "abc"] + ["".join(rng.choice(list("abc"), rng.integers(2, 6))) for _ in range(60)]
    less = [{w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 3 else set()) for w in words]
    made = left_out(spark.createDataFrame([(n, [w], n % 2) for n, w in enumerate(words)], "n int, sounds array<string>, b int"), F.col("b"), "n").distinct().collect()
    keys = [{r["key"] for r in made if r["n"] == n} for n in range(len(words))]
    assert [len(k) for k in keys] == [len(k) for k in less]
    for i in range(len(words)):
        for j in range(i):
            assert bool(keys[i] & keys[j]) == bool(i % 2 == j % 2 and less[i] & less[j])


def test_keys_are_shuffled_once(spark):
    keyed = spark.range(2000).select(F.col("id").alias("nth"), F.col("id").alias("rank"), F.explode(F.array(F.xxhash64("id"), F.xxhash64(F.lit("two"), F.floor(F.col("id") / 2)), F.lit(None))).alias("key")).where("key is not null")
    before = _written(spark)
    pairs = ranked_pairs(keyed, F.lit(True))
    assert _written(spark) - before <= 4000 + 2 * 1000
    assert {(r["variant"], r["candidate"]) for r in pairs.collect()} == {(n, n + 1) for n in range(0, 2000, 2)}


def test_what_the_index_multiplies_is_not_shuffled(spark):
    values = spark.createDataFrame([(f"Republik Uzbekistn {chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(200)], "value string")
    before = _written(spark)
    found = canonical_countries(spark, values).collect()
    assert len(found) == 200 and {r["code"] for r in found} == {"UZ"}
    assert _written(spark) - before < 200 * 400


def test_what_persons_are_compared_by_moves_twice(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abdegilmnorst"), 7))
    rows = [(n, f"{word()} {word()}", "wikidata", f"Q{n}", "FR", "x", f"{word()} SA", None, f"19{50 + n % 40}-03-{1 + n % 28:02}", {}) for n in range(0, 1200, 2)]
    rows += [(n + 1, name[:-1], s, f"Z{k}", *rest) for n, name, s, k, *rest in rows]
    people = spark.createDataFrame(rows, "id bigint, name string, source string, source_id string, country string, known_for_role string, known_for_org string, known_for_org_id bigint, birth_date string, record map<string,string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _written_bytes(spark)
        pairs = person_pairs(spark, people, None, spark.createDataFrame([("FR", "FR")], "value string, code string")).collect()
        moved = _written_bytes(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["key_a"], r["key_b"]) for r in pairs} == {(n, n + 1) for n in range(0, 1200, 2)}
    assert moved < 1200 * 700  # bytes a row; 750 with the entries numbered, counted and joined one after another
