from siftworks.llm.cascade import match_sources, row_pairs
from siftworks.llm.orgnames import parse
from siftworks.llm.orgs import source_groups
from siftworks.llm.personnames import parse as person
from siftworks.llm.variants import spelling_variants

LEI = "ZZ9Q2A7KJT7AJAOGNR08"
ROWS = [
    (1, "Trita Mozeork Water Limited", "gleif", LEI, "GB", "1951-09-04", {"city": "Jiveos"}),
    (2, "Trita Mozeork Water Ltd", "sec_edgar", "7", "England", "1951-09-04", {"city": "JIVEOS"}),
    (3, "TRITA MOZEOKR WTR LTD.", "wikidata", "Q7", "United Kingdom", "1951-10-04", {"city": "Jiveos"}),
    (4, "Trita Mozeork Mining Limited", "sec_edgar", "8", "GB", "1988-01-05", {"city": "Other"}),
    (5, "Trita Mozeork Water GmbH", "sec_edgar", "9", "DE", "1999-03-04", {"city": "Ulm"}),
    (6, "Trita Mozeork Water Fund II Limited", "wikidata", "Q8", "GB", "1951-09-04", {}),
    (7, "Trita Mozeork Water", "companies_house", "X9", "GB", None, {"lei": LEI}),
    (8, "N/A", "wikidata", "Q9", None, None, None),
    (9, None, "wikidata", "Q10", "GB", "", {}),
    (10, "Trita Mozeork Water", "sec_edgar", "77", "GB", None, {"city": "Jiveos"}),
]


def test_names_are_taken_apart():
    assert parse("The Povi-Steglimm Res. Inst. PLC")[:4] == (["povi", "steglimm"], "res", 0, "plc")
    assert parse("KreojomDacous Transport Fund IV L.L.C. /US/") == (["kreojom", "dacous"], "tra", 4, "llc", "US")
    assert parse("A/S")[0] == [] and parse("")[0] == []
    assert person("Dr. DONAIDRON, Anne-Marie E. MBA") == ["anne", "marie", "e", "donaidron"]


def test_cascade(spark, orgs):
    rows = orgs(ROWS).drop("name_normalized", "entity_type", "to_date")
    got = {(r["id_a"], r["id_b"]) for r in row_pairs(rows, source_groups(rows), match_sources(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 7), (3, 7), (1, 10), (3, 10), (7, 10)}
    assert match_sources(spark, rows.limit(0)).count() == 0


def people(spark, rows):
    schema = "id bigint, name string, source string, source_id string, country string, known_for_role string, known_for_org string, known_for_org_id bigint, birth_date string, record map<string,string>"
    return spark.createDataFrame(rows, schema)


def test_variants(spark, orgs):
    titles = spark.createDataFrame([("DIR", "Director"), ("CEO", "Chief Executive Officer")], "code string, title string")
    staff = people(
        spark,
        [
            (101, "Patricia Trifeolus", "wikidata", "Q1", "GB", "Director", "Foo", 3, "1935-01-16", {}),
            (102, "Trish Trifeolus", "sec_edgar", "2", "England", "Dir.", None, None, "1935-01-16", None),
            (103, "TRIFEOLUS, Patricia A.", "companies_house", "3", "GB", "Director", "Foo", 3, "1935-01", {}),
            (104, "Patricia Trifeolus", "companies_house", "4", "GB", "Chief Executive Officer", "Bar", 4, "1971-05-07", {}),
            (105, "Alexander Trifeolus", "companies_house", "5", "GB", "Director", "Foo", 3, "1935-01-16", {}),
            (106, None, "companies_house", "6", None, None, "TRITA MOZEORK WATR LIMITED", None, None, None),
            (107, "", "companies_house", "7", "", "", "Nobody Knows Water Limited", None, "", {}),
            (108, "Someone Else", "companies_house", "8", "FR", None, "Trita Mozeork Water Limited", None, None, {}),
        ],
    )
    got = spelling_variants(spark, orgs(ROWS), staff, titles).collect()
    kinds = {k: {(r["key_a"], r["key_b"]) for r in got if r["kind"] == k} for k in ("person", "org", "employer")}
    assert kinds["person"] == {(101, 102), (101, 103), (102, 103)}
    assert kinds["org"] == {(2, 10)}
    assert {b for _, b in kinds["employer"]} == {106} and {a for a, _ in kinds["employer"]} == {1, 2, 3, 7, 10}
    assert spelling_variants(spark, orgs([]), staff.limit(0), titles).count() == 0


def persons(spark, orgs, rows):
    titles = spark.createDataFrame([("DIR", "Director")], "code string, title string")
    got = spelling_variants(spark, orgs([]), people(spark, rows), titles).where("kind = 'person'").collect()
    return {(r["key_a"], r["key_b"]) for r in got}


OTHERS = "Baskorim Celtunda Dorvimex Fargostil Gremolund Hulvistar Jorbatek Lumvarest Mordivask Pelgrunto Quistamor Rovandisk".split()


def test_misspelt_surname_with_a_frequent_given_name(spark, orgs):
    rows = [(i, f"Andrew {s}", "wikidata", f"Q{i}", "FR", None, None, None, f"19{40 + 3 * i}-02-11", {}) for i, s in enumerate(OTHERS)]
    rows += [
        (101, "Andrew Keohukund", "wikidata", "Q101", "ES", "Director", "Foo", 3, "1955-01", {}),
        (102, "Andrew Keohuknd", "sec_edgar", "102", "ES", "Director", "Foo", 3, "1955-01-07", {}),
        (103, "Andrew Tervolast", "wikidata", "Q103", "ES", "Director", "Foo", 3, "1981-05", {}),
        (201, "A. Broudibus", "wikidata", "Q201", "ES", "Director", "Bar", 4, None, {}),
        (202, "Andrew Broudubus", "sec_edgar", "202", "ES", "Director", "Bar", 4, "1962-03", {}),
        (301, "Andew Mikaltesin", "wikidata", "Q301", "ES", None, None, None, "1971-09-30", {}),
        (302, "Andrew Mikalteson", "sec_edgar", "302", "ES", None, None, None, "1971-09-30", {}),
    ]
    assert persons(spark, orgs, rows) == {(101, 102), (301, 302)}


def test_frequent_surname_with_partial_births(spark, orgs):
    given = "Agnes Bruno Carmen Dieter Elena Felix Greta Hugo Irina Jonas Klara Ludwig".split()
    rows = [(i, f"{g} Stibaitrind", "wikidata", f"Q{i}", "FR", None, None, None, f"19{40 + 3 * i}-02-11", {}) for i, g in enumerate(given)]
    rows += [
        (101, "Rosalind Stibaitrind", "wikidata", "Q101", "ES", "Director", None, None, "1955-01", {}),
        (102, "Roslind Stibaitrind", "sec_edgar", "102", "ES", "Director", None, None, "1955-01-07", {}),
        (103, "Rosalind Stibaitrind", "sec_edgar", "103", "ES", "Director", None, None, "1955-08", {}),
    ]
    assert persons(spark, orgs, rows) == {(101, 102)}


def test_surname_of_two_letters(spark, orgs):
    rows = [
        (101, "Rosalind Wu", "wikidata", "Q101", "ES", "Director", None, None, "1955-01", {}),
        (102, "Roslind Wu", "sec_edgar", "102", "ES", "Director", None, None, "1955-01-07", {}),
        (103, "Rosalind Wu", "sec_edgar", "103", "ES", "Director", None, None, "1955-08", {}),
    ]
    assert persons(spark, orgs, rows) == {(101, 102)}


def test_employer_with_slips_in_both_words(spark, orgs):
    known = [(1, "Vifel Basoth Foundation Inc.", "gleif", "1", "US", None, {}), (2, "Draikrim Vouniuth Capital AG", "gleif", "2", "DE", None, {}), (3, "Sorvel Tanoth Capital AG", "gleif", "3", "DE", None, {})]
    texts = ["Vifrl Basotj Foundation Inc.", "draikrimvuoniuth capital ag", "Nobody Basketry Foundation Inc."]
    staff = people(spark, [(101 + i, "Some One", "wikidata", f"Q{i}", "US", None, t, None, None, {}) for i, t in enumerate(texts)])
    got = spelling_variants(spark, orgs(known), staff).where("kind = 'employer'").collect()
    assert {(r["key_a"], r["key_b"]) for r in got} == {(1, 101), (2, 102)}
