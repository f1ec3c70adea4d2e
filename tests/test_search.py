import numpy as np

from siftworks.operators import search
from siftworks.plans.relational import first_sentences

WORDS = ("north", "northern", "ern", "gas", "fund", "bank", "ab", "x")


def _rows(n, seed=7):
    rng = np.random.default_rng(seed)
    names = [" ".join(rng.choice(WORDS, rng.integers(1, 4))) for _ in range(n)]
    vectors = rng.normal(size=(n, 4)).round(3)
    vectors[n // 2 :] = vectors[: n - n // 2]  # ties
    vectors[3] = 0
    names[5], names[6] = None, ""
    return list(range(n)), names, vectors


def _terms(text):
    words = text.split()
    kept = [w for w in words if len(w) >= 3] if len(words) > 1 else words
    return [w for _, _, w in sorted((-len(w), i, w) for i, w in enumerate(kept))][:3]


def _expected(ids, names, vectors, texts, k):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    out = {}
    for q, text in texts.items():
        met = [] if text is None or not vectors[q].any() else [i for i in ids if vectors[i].any() and (text == "" or any(t in (names[i] or "") for t in _terms(text)))]
        out[q] = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in met)[:k]
    return {q: [i for _, i in found] for q, found in out.items() if found}


def _found(spark, k, **more):
    ids, names, vectors = _rows(120)
    texts = {i: names[i] for i in range(0, 120, 3)} | {7: "", 9: None, 10: "th", 11: "of gas gas", 13: "xx ab", 3: "gas"}
    queries = spark.createDataFrame([(q, t, vectors[q].tolist()) for q, t in texts.items()], "query_id bigint, query_text string, embedding array<float>")
    rows = spark.createDataFrame([(i, names[i], vectors[i].tolist()) for i in ids], "id bigint, name_normalized string, embedding array<float>")
    found: dict[int, list] = {}
    out = search._similar(queries, rows.select("id", "name_normalized"), rows.select("id", "embedding"), lambda x: x, k, **more).collect()
    for r in sorted(out, key=lambda r: (r["query_id"], -round(r["similarity"], 9), r["id"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    return found, _expected(ids, names, vectors.astype(np.float32).astype(np.float64), texts, k)


def test_candidates_against_brute_force(spark):
    for k in (1, 7, 1000):
        found, expected = _found(spark, k)
        assert found == expected


def test_candidates_in_several_groups_of_queries(spark):
    found, expected = _found(spark, 2000, block_mb=1)  # 45 queries of 64 KB each
    assert found == expected


def test_the_driver_keeps_no_group_of_queries(spark, monkeypatch):
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(send(sc, value)) or sent[-1])
    found, expected = _found(spark, 2000, block_mb=1)
    assert len(sent) > 1 and found == expected
    assert not any(b._jbroadcast.isValid() for b in sent)


def _written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_queries_and_names_are_not_shuffled(spark):
    people = spark.range(3000).selectExpr("id", "concat('Common Name', id) as name", "concat('common name', id) as name_normalized", "'CEO' as known_for_role", "'Acme' as known_for_org")
    vectors = spark.range(3000).selectExpr("id", "array(cast(1 + id % 7 as float), cast(1 + id % 11 as float)) as embedding")
    asked = people.where("id < 400").join(vectors, "id").selectExpr("id as query_id", "name as query_text", "known_for_role as role", "known_for_org as org", "embedding")
    before = _written(spark)
    assert search.search_people(asked, people, vectors).count() == 400 * 30
    assert _written(spark) - before < 400 * 3000 / 10


def test_terms_are_found_within_words():
    index = search._Terms(["ern", "north", "b"])
    met = index.rows(["northern bb b", None, "", "gas", "ern ern"])
    assert {t: list(at) for t, at in met.items()} == {0: [0, 4], 1: [0], 2: [0]}


def test_first_sentences_against_brute_force(spark):
    rng = np.random.default_rng(5)
    subjects = ["", " ", "a", "ab", "abc", "Ann", "ann", "Jo Li", "Jo Livingstone", "Jo  Livingstone", " Jo Livingstone ", "Mr. Jo Livingstone Jr.", "J. Li", "x\ny zzzzzzz", "Zoë Müllerová", "o L", None]
    rows = []
    for n in range(400):
        subject, object_ = subjects[rng.integers(len(subjects))], ["Acme", "Acme Ann", "", None][rng.integers(4)]
        text = None if n % 50 == 1 else "".join(str(subjects[i]) for i in rng.integers(0, len(subjects), 3)) + " is chief of " + str(object_)
        rows.append((n, object_, subject, text))
    best = {}
    for seq, o, subject, _ in rows:
        met = [n for n, about, _, text in rows if None not in (o, subject, text) and about == o and subject in text]
        if met:
            best[seq] = min(met)
    found = first_sentences(spark.createDataFrame(rows, "seq bigint, object string, subject string, source_text string")).collect()
    assert len(found) == len(best) and {r["seq"]: r["sentence"] for r in found} == best


def test_subjects_and_sentences_of_one_object_do_not_all_meet(spark):
    rows = spark.range(3000).selectExpr("id as seq", "'Acme' as object", "concat('Jo Name', id) as subject", "concat('Jo Name', id, ' is chief') as source_text")
    met = []
    for x in first_sentences(rows)._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        if "Join" in x and "Contains" in x:
            met.append(x)
    assert met and all("sentence#" in x for x in met)  # compared as pairs that share a piece of text, not as all of an object
    assert first_sentences(rows).count() == 3000
