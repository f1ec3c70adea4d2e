import pytest
from pyspark.sql import functions as F

from siftworks import pipeline


def test_stages():
    assert pipeline.parse_stages("1-3,5") == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        pipeline.parse_stages("0-9")


def test_registry_orders_and_refuses_repeats():
    r = pipeline.Registry()
    r.register("labeler", "late", 200)(lambda df: df)
    r.register("labeler", "early", 10, ["ORG"])(lambda df: df)
    assert [p.name for p in r.all("labeler")] == ["early", "late"] and r.first("labeler", ["early"]).name == "late"
    assert [p.name for p in r.all("labeler", entity_type="PERSON")] == ["late"]
    with pytest.raises(ValueError):
        r.register("labeler", "late")(lambda df: df)


def test_run(spark):
    docs = spark.createDataFrame([(1, "Acme Water acquired Foo Ltd. Acme Water acquired Foo Ltd. It rained."), (2, None), (3, "")], "doc_id bigint, text string")
    got = pipeline.run(docs).collect()
    assert [(r["doc_id"], r["subject"], r["predicate"], r["object"], r["sentence_no"]) for r in got] == [(1, "Acme Water", "acquired", "Foo Ltd", 0)]
    assert [x["label_type"] for x in got[0]["labels"]] == ["sentiment", "relation_type"] and got[0]["labels"][0]["label_value"] == "positive"
    assert pipeline.run(docs, "1").count() == 3


def test_greedy_dedup(spark):
    rows = [(1, "Google", "acquired", "YouTube", [1.0, 0.0]), (2, "youtube", "bought", "The Google", [0.9, 0.1]), (3, "Google", "sued", "YouTube", [0.0, 1.0]), (4, "Google", "acquired", "Other", [1.0, 0.0]), (5, "google", "ACQUIRED", "YouTube", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "seq bigint, subject string, predicate string, object string, embedding array<double>")
    assert sorted(r["seq"] for r in pipeline.greedy_dedup(df).collect()) == [1, 3, 4]


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("a b",), ("b A",), (None,)], "t string").select(pipeline.hash_embedding(F.col("t"), 8).alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and set(rows[2]["v"]) == {0.0}
