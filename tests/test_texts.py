import numpy as np
from pyspark.sql import functions as F

from siftworks.functions import labels as L
from siftworks.operators import statements as S
from siftworks.operators.chunks import chunk_documents, chunk_spans
from siftworks.operators.html import page_text
from siftworks.operators.knn import nearest
from siftworks.streaming.incremental import counts_by_window, deduplicated, import_landed


def test_sentiment(spark):
    texts = {"Company announced great quarterly earnings": "positive", "Company lost significant market share": "negative", "Company is located in California": "neutral", "": "neutral"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.sentiment(F.col("t")).alias("s"))
    assert {r["t"]: r["s"]["label"] for r in rows.collect()} == texts


def test_role_and_pages(spark):
    row = spark.createDataFrame([("Tim Cook, CEO of Apple, announced", "Just a moment... checking your browser", "http://x/a.PDF?x=1")], "t string, h string, u string")
    got = row.select(L.role_in_text(F.col("t")), L.challenge_page(F.col("h")), L.content_kind(F.col("u"), F.lit(None).cast("string"))).first()
    assert tuple(got) == ("CEO", True, "pdf")


def test_chunks_cover_the_text(spark):
    text = "Sentence one is here. And a second one follows it!\n\nA third. " * 60
    for target, most, overlap in ((50, 80, 10), (30, 40, 0), (100, 200, 20)):
        spans = chunk_spans(text, target, most, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(n <= most for _, _, n in spans)
        assert all(a2 <= b1 and a2 > a1 and b2 > b1 for (a1, b1, _), (a2, b2, _) in zip(spans, spans[1:]))
    docs = spark.createDataFrame([(1, "short text"), (2, None), (3, "  "), (4, text)], "doc_id bigint, text string")
    got = chunk_documents(docs, 50, 80, 10).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {1, 4}


def test_unbroken_text_ends(spark):
    spans = chunk_spans("a" * 50 + "!" * 5000, 100, 200, 50)
    assert spans[-1][1] == 5050 and all(n <= 200 for _, _, n in spans)


def test_html(spark):
    html = """<html><head><title>Article Title | Site Name</title><meta name="author" content="Ann"><meta property="og:description" content="About"></head>
      <body><nav>Menu</nav><div class="cookie-banner">Cookies</div><article><h1>Head</h1><script>bad()</script><p>%s</p><br></article><footer>Foot</footer></body></html>""" % ("Long text. " * 20)
    got = spark.createDataFrame([(html,), (None,)], "h string").select(page_text(F.col("h")).alias("p")).select("p.*").collect()
    assert got[0]["title"] == "Article Title" and got[0]["author"] == "Ann" and got[0]["description"] == "About"
    assert "Long text." in got[0]["text"] and not any(w in got[0]["text"] for w in ("Menu", "Cookies", "bad()", "Foot"))
    assert got[1]["text"] == ""


def test_statements_round_trip_and_repair(spark):
    raw = "<statements><stmt><subject type='org'>A & B</subject><predicate>owns</predicate><object>C</object><text>A & B owns C.</text></stmt><stmt><subject>cut"
    rows = spark.createDataFrame([(raw,)], "x string").select(S.repair_xml(F.col("x")).alias("x"))
    got = S.parse_xml(rows, "x").drop("x").collect()
    assert [tuple(r) for r in got] == [(0, "A & B", "ORG", "owns", "C", "UNKNOWN", "A & B owns C.")]
    mixed = spark.createDataFrame([('[{"subject": "a", "predicate": "p", "object": "o"}]',), ('{"labeled_statements": [{"subject": "b", "predicate": "q", "object": "r", "text": "t"}]}',), ("<statements><stmt><subject>c</subject><predicate>s</predicate></stmt>",), ("junk",)], "x string")
    assert {(r["subject"], r["text"]) for r in S.parse_any(mixed, "x").collect()} == {("a", "a p o"), ("b", "t"), ("c", "c s")}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    found = nearest(rows.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), rows, 5).collect()
    unit = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    score = np.round(unit @ unit.T, 9)
    for q in range(20):
        mine = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: (-round(r["similarity"], 9), r["vec_id"]))]
        keys = [i for i in range(200) if i != 7]
        assert mine == ([] if q == 7 else sorted(keys, key=lambda i: (-score[q, i], i))[:5])


def test_streams(spark, tmp_path):
    landed, out = tmp_path / "in", tmp_path / "out"
    landed.mkdir()
    (landed / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    import_landed(spark, str(landed), "id int", str(out), str(tmp_path / "cp")).awaitTermination()
    (landed / "b.json").write_text('{"id": 3}\n')
    import_landed(spark, str(landed), "id int", str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3]
    events = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'view' as event_type, 1.5 as value union all select timestamp'2024-01-01 11:00:00', 'view', 2.0")
    assert [tuple(r)[1:] for r in counts_by_window(events).collect()] == [("view", 2, 3.5)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"subject": "A", "predicate": "p", "object": "b", "at": "2024-01-01T00:00:00"}\n{"subject": " a ", "predicate": "P", "object": "B", "at": "2024-01-01T00:00:01"}\n')
    stream = spark.readStream.schema("subject string, predicate string, object string, at timestamp").json(str(tmp_path / "s"))
    query = deduplicated(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.awaitTermination()
    assert spark.table("once").count() == 1
