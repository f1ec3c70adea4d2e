from pyspark.sql import functions as F

from siftworks.llm import names
from siftworks.llm.survivors import align, consensus, consensus_values, distance, duplicate_groups, survivors, tokens


def test_alignment_and_vote():
    profile = []
    for text, w in (("acme water limited", 3.0), ("acme water", 2.0), ("acne water limited", 1.0)):
        column = [{t: w} for t in tokens(text)]
        profile = align(profile, column) if profile else column
    assert consensus(profile) == ["acme", "water", "limited"]
    assert distance(["a", "b"], ["a", "b"]) == 0 and distance(["a"], []) == 1


def test_usable_values(spark):
    rows = [("Acme Ltd", "X1", True), ("N/A", "X1", False), ("???", "1", False), ("-", "1", False), ("", "1", False), (None, "1", False), ("name not available", "1", False), ("Q900012", "Q1", False),
            ("ZZ9Q2A7KJT7AJAOGNR08", "1", False), ("LEI: ZZ9Q2A7KJT7AJAOGNR08", "1", False), ("ABCDEFGH", "ABCDEFGH", False), ("3M Company", "1", True), ("UNKNOWN", "1", False), ("12345678", "1", False), ("IBM", "1", True)]
    df = spark.createDataFrame(rows, "n string, k string, want boolean")
    assert [r["n"] for r in df.where(names.usable_name(F.col("n"), F.col("k")) != F.col("want")).collect()] == []
    dates = [("2001-02-28", True), ("2001-02-30", False), ("1900-01-01", False), ("9999-12-31", False), ("0000-00-00", False), ("2001", False), ("2001-02", False), ("1982-13-45", False), ("", False), (None, False)]
    df = spark.createDataFrame(dates, "d string, want boolean")
    assert df.where(names.usable_date(F.col("d")) != F.col("want")).count() == 0


def test_groups_join_through_others(spark, orgs):
    lei = "ZZ9Q2A7KJT7AJAOGNR08"
    rows = orgs([(1, "A", "gleif", lei, None, None, {}), (2, "B", "sec_edgar", "7", None, None, {"lei": "lei: zz9q-2a7kjt7ajaognr08"}), (3, "C", "sec_edgar", "7", None, None, None),
                 (4, "D", "wikidata", "7", None, None, {"lei": "short"}), (5, "E", "wikidata", "", None, None, {}), (6, "F", "wikidata", "", None, None, {})])
    key = F.when((F.col("source") != "") & (F.col("source_id") != ""), F.concat_ws("|", "source", "source_id"))
    got = {r["id"]: r["group_id"] for r in duplicate_groups(rows, [key, names.lei(F.col("source"), F.col("source_id"), F.col("record"))]).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_priority_beats_numbers_and_votes_do_not(spark):
    rows = [(1, 8, "Acme Watr", 1, 1.0), (1, 2, "Acme Water Ltd", 2, 2.0), (1, 3, "Acme Water Ltd", 2, 3.0), (1, 4, "Acme Water Ltd", 2, 3.0), (2, 5, "Only", 4, None), (1, 7, None, 1, 9.0), (3, 10, "Late", 1, 5.0), (3, 11, "Early", 1, 4.0)]
    df = spark.createDataFrame(rows, "g int, id bigint, value string, trust int, at double")
    first = {r["g"]: (r["value"], r["row_id"]) for r in survivors(df, ["g"], F.col("trust"), F.col("at")).collect()}
    assert first == {1: ("Acme Watr", 8), 2: ("Only", 5), 3: ("Late", 10)}
    voted = {r["g"]: r["value"] for r in survivors(df, ["g"], F.col("trust"), F.col("at"), priority=False).collect()}
    assert voted[1] == "Acme Water Ltd"
    assert survivors(df.limit(0), ["g"], F.col("trust"), F.col("at")).count() == 0


def test_a_large_group_is_merged_in_blocks(spark):
    values = [(1, f"Acme Water {i} Limited", 1.0, i) for i in range(300)] + [(1, "Acme Water Limited", 2.0, 999)]
    df = spark.createDataFrame(values, "g int, value string, weight double, rank int")
    assert [r["value"] for r in consensus_values(df, ["g"], block=8).collect()] == ["Acme Water Limited"]


def test_ties_repeats_and_other_columns(spark):
    rows = [(1, 5, "B", 2, 1.0, "x"), (1, 3, "A", 2, 1.0, "y"), (1, 3, "A", 2, 1.0, "y"), (2, 9, "same", 1, None, "z"), (2, 8, "same", 1, None, None)]
    df = spark.createDataFrame(rows, "g int, id bigint, value string, trust int, at double, weight string")
    got = {r["g"]: (r["value"], r["row_id"]) for r in survivors(df, ["g"], F.col("trust"), F.col("at")).collect()}
    assert got == {1: ("A", 3), 2: ("same", 8)}
