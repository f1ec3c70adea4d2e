import pytest
from pyspark.sql import functions as F

from siftworks.functions import normalize as N
from siftworks.functions.regions import region_lookup, with_region
from siftworks.functions.text import fold, words


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("make", "pairs"),
    [
        (N.canon_name, {"Apple Inc": "apple inc", "Amazon Ltd.": "amazon ltd", "Test  Corp  ": "test corp"}),
        (N.expand_suffix, {"Amazon Ltd": "amazon limited", "Test Corp": "test corporation", "Apple Inc": "apple incorporated", "Google": "google"}),
        (N.normalize_org_name, {"Amazon's Services, Inc.": "amazon services", "Ltd": "ltd", "Foo [Bar] Holdings LLC": "foo bar", "": ""}),
        (N.normalize_person_name, {"Dr. Prof. Ann Lee Jr.": "ann lee", "Sir": "sir", "Ludwig van Beethoven III": "ludwig van beethoven"}),
        (N.entity_form, {"  The  Big Apple ": "big apple", "An": "", "theory": "theory"}),
        (N.title_case, {"o'NEIL mc-d": "O'Neil Mc-D", "ann  LEE": "Ann Lee"}),
        (N.compact_date, {"20240131": "2024-01-31", "202401": "2024-01", "x": None}),
        (N.parse_qid, {"Q2283": 2283, "q7": 7, "x": None}),
        (lambda c: N.truncate_label(c, 20), {"a" * 21: "a" * 17 + "...", "short": "short"}),
        (fold, {"Ølgård Straße": "olgard strasse"}),
        (words, {"S.p.A. & Co-Op (UK)": "spa co op uk"}),
    ],
)
def test_scalar_forms(spark, make, pairs):
    assert column(spark, list(pairs), make) == list(pairs.values())


def test_null_stays_null_or_blank(spark):
    assert column(spark, [None], N.canon_name) == [None]
    assert column(spark, [None], N.normalize_org_name) == [""]


def test_search_terms_are_the_longest_words(spark):
    assert column(spark, ["of the great northern water company", "ab"], N.search_terms) == [["northern", "company", "great"], ["ab"]]


def test_regions(spark):
    countries = spark.createDataFrame([("GB", "United Kingdom"), ("US", "United States"), ("CA", "Canada"), ("DE", "Germany"), ("FR", "France")], "code string, name string")
    want = {"GBR": "GB", "UK": "GB", "U.K.": "GB", "England": "GB", "USA": "US", "NY": "US", "California": "US", "CA": "CA", "DEU": "DE", "France": "FR", "": "", "XYZ123": "", " uk ": "GB"}
    rows = spark.createDataFrame([(k,) for k in want], "region string")
    got = {r["region"]: r["iso"] for r in with_region(rows, "region", region_lookup(spark, countries)).collect()}
    assert got == want


def test_citation_and_qualified_name(spark):
    row = spark.createDataFrame([("Annual Report", ["Alice", "Bob"], 2024, 5)], "t string, a array<string>, y int, p int")
    assert row.select(N.citation(F.col("t"), F.col("a"), F.col("y"), F.col("p"))).first()[0] == "Annual Report - Alice & Bob - 2024 - p. 5"
    names = spark.createDataFrame([("Tim Cook", "CEO", "Apple", "ceo")], "n string, a string, b string, c string")
    assert names.select(N.qualified_name(F.col("n"), F.col("a"), F.col("b"), F.col("c"))).first()[0] == "Tim Cook (CEO, Apple)"
