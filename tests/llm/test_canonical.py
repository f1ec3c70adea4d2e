from siftworks.llm.canonical import canonical_countries, canonical_roles

COUNTRIES = {
    "UK": "GB", "gbr": "GB", "  United Kingdom.": "GB", "United Kindgom": "GB", "England": "GB", "(Scotland)": "GB", "GB/GBR": "GB", "Deutschland": "DE", "DE - Germany": "DE", "Bayern": "DE", "Germnay": "DE", "Iatly": "IT", "CA": "CA", "NY": "US",
    "California": "US", "U.S.A.": "US", "Korea, Republic of": "KR", "Österreich": "AT", "HomgK ong": "HK", "Suisse": "CH", "EMEA": None, "XYZ123": None, "n/a": None, "": None, "ZZ": None, "Braglaith Isles": None, "Russland": "RU",
}
ROLES = {
    "CEO": "CEO", "acting C.E.O.": "CEO", "Chief Exec. Officer [current]": "CEO", "Vorstandsvorsitzender": "CEO", "Dirctr": "DIR", "ex-Company Director": "DIR", "Director, since 2011": "DIR", "Non-exec Director": "NED", "10% Owner": "OWN",
    "Co founder / Group": "COF", "Co-Founnder": "COF", "Co. Secretary": "SEC", "Sr VP": "SVP", "Chief Finanxial Offiker": "CFO", "M.P.": "MPA", "Chairwoman": "CHA", "Beekeeper": None, "ROLE_7933": None, "#9745": None, "?": None,
}
TITLES = (
    "DIR Director;SEC Company Secretary;CEO Chief Executive Officer;CFO Chief Financial Officer;NED Non-Executive Director;EXD Executive Director;OWN Ten Percent Owner;COF Co-Founder;FDR Founder;VPR Vice President;SVP Senior Vice President;"
    "PRS President;MPA Member of Parliament;CHA Chair of the Board;VCH Vice Chair"
)


def test_countries(spark):
    values = spark.createDataFrame([(v, 1) for v in [*COUNTRIES, *COUNTRIES, None]], "value string, code int")
    got = {r["value"]: r["code"] for r in canonical_countries(spark, values).collect()}
    assert got == {k: v for k, v in COUNTRIES.items() if k.strip()}


def test_roles(spark):
    titles = spark.createDataFrame([tuple(t.split(" ", 1)) for t in TITLES.split(";")], "code string, title string")
    values = spark.createDataFrame([(v,) for v in ROLES], "value string")
    assert {r["value"]: r["code"] for r in canonical_roles(spark, values, titles).collect()} == ROLES


def test_empty_and_long(spark):
    values = spark.createDataFrame([("x" * 20_000,), (None,), ("  ",)], "value string")
    assert [r["code"] for r in canonical_countries(spark, values).collect()] == [None]
    assert canonical_countries(spark, values.limit(0)).count() == 0
