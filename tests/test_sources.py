import json

from siftworks.sources import registries as R


def lines(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


LEI = "ZZ9Q" + "0" * 14 + "01"


def api(name, status="ACTIVE", lei=LEI):
    return {"id": lei, "attributes": {"lei": lei, "entity": {"legalName": {"name": name}, "status": status, "category": "FUND", "legalAddress": {"city": "Ulm", "country": "DE"}, "creationDate": "2001-02-03T00:00:00Z"}}}


def test_gleif_lines_array_and_xml_agree(spark, tmp_path):
    other = {"LEI": {"$": LEI}, "Entity": {"LegalName": {"$": "Old Form"}, "EntityCategory": {"$": "BRANCH"}, "LegalAddress": {"Country": {"$": "FR"}}}}
    nd = lines(tmp_path, "a.jsonl", "\n".join([json.dumps(api("Foo Fund")), "{broken", json.dumps(api("Gone", "INACTIVE")), json.dumps(api("Short", lei="X")), json.dumps(other)]))
    got = {r["name"]: r for r in R.gleif_file(spark, nd).collect()}
    assert set(got) == {"Foo Fund", "Old Form"}
    assert (got["Foo Fund"]["region"], got["Foo Fund"]["entity_type"], got["Foo Fund"]["from_date"], got["Foo Fund"]["record"]["city"]) == ("DE", "fund", "2001-02-03", "Ulm")
    arr = lines(tmp_path, "b.json", json.dumps([api("Foo Fund"), api("Gone", "INACTIVE")]))
    assert [r["name"] for r in R.gleif_file(spark, arr).collect()] == ["Foo Fund"]
    data = lines(tmp_path, "c.json", json.dumps({"data": [api("Foo Fund")]}))
    assert [r["name"] for r in R.gleif_file(spark, data).collect()] == ["Foo Fund"]
    xml = lines(tmp_path, "d.xml", f"""<lei:LEIData xmlns:lei="http://x"><lei:LEIRecords><lei:LEIRecord><lei:LEI>{LEI}</lei:LEI><lei:Entity><lei:LegalName xml:lang="de">Foo Fund</lei:LegalName>
      <lei:EntityStatus>ACTIVE</lei:EntityStatus><lei:EntityCategory>FUND</lei:EntityCategory><lei:LegalAddress><lei:City>Ulm</lei:City><lei:Country>DE</lei:Country></lei:LegalAddress></lei:Entity></lei:LEIRecord></lei:LEIRecords></lei:LEIData>""")
    row = R.gleif_file(spark, xml).first()
    assert (row["name"], row["source_id"], row["entity_type"], row["region"]) == ("Foo Fund", LEI, "fund", "DE")


def test_sec(spark, tmp_path):
    tick = R.sec_tickers(spark, lines(tmp_path, "t.json", json.dumps({"0": {"cik_str": 320, "ticker": "AAA", "title": "A Inc"}})))
    assert tuple(tick.first()) == ("0000000320", "AAA", "A Inc")
    subs = [
        {"cik": "320", "name": "A Inc", "entityType": "other", "filings": {"recent": {"filingDate": ["2024-01-01", "1999-05-06"]}}, "addresses": {"business": {"stateOrCountry": "NY", "city": "X"}}},
        {"cik": "7", "name": "B Fund", "entityType": "other", "sic": "6726"}, {"cik": "8", "name": "Person", "entityType": "other"},
    ]
    raw = spark.createDataFrame([(json.dumps(s),) for s in subs], "j string")
    got = {r["name"]: r for r in R.sec_submissions(raw, "j", tick).collect()}
    assert set(got) == {"A Inc", "B Fund"} and got["A Inc"]["from_date"] == "1999-05-06" and got["A Inc"]["record"]["ticker"] == "AAA" and got["B Fund"]["entity_type"] == "fund"
    idx = R.form_index(spark, lines(tmp_path, "form.idx", "Form Type  Company\n4        ACME & SONS INC     0001234567   2024-01-02  edgar/data/12/0001-24-000005.txt\n4/A  X 1234567 d f\n"))
    assert tuple(idx.first()) == ("ACME & SONS INC", "0001234567", "2024-01-02", "edgar/data/12/0001-24-000005.txt", "0001-24-000005") and idx.count() == 1
    doc = """<ownershipDocument><periodOfReport>2024-03-01</periodOfReport><issuer><issuerCik>0000320</issuerCik><issuerName>A Inc</issuerName></issuer>
      <reportingOwner><reportingOwnerId><rptOwnerCik>00055</rptOwnerCik><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
      <reportingOwner><reportingOwnerId><rptOwnerCik>66</rptOwnerCik><rptOwnerName>NOBODY</rptOwnerName></reportingOwnerId></reportingOwner></ownershipDocument>"""
    got = R.form4_owners(spark.createDataFrame([(doc,)], "x string"), "x").collect()
    assert [(r["name"], r["source_id"], r["known_for_role"], r["person_type"]) for r in got] == [("Doe Jane", "55_320", "Director, CFO", "executive")]


def test_companies_house(spark, tmp_path):
    csv = "CompanyName, CompanyNumber,CompanyStatus,CompanyCategory,IncorporationDate,DissolutionDate,CountryOfOrigin,SICCode.SicText_1\n\"Foo, Ltd\",0001,Active,Private Limited Company,02/03/2001,,United Kingdom,62\nBar,0002,Dissolved,Private Limited Company,,,,\nBaz,0003,Active,Unknown Thing,,,,\nQux,0004,Open,Royal Charter Company,,,,\n"
    rows = R.companies_house_csv(spark, lines(tmp_path, "c.csv", csv)).collect()
    assert [(r["name"], r["from_date"], r["entity_type"], r["record"].get("sic")) for r in rows] == [("Foo, Ltd", "2001-03-02", "business", "62"), ("Qux", "", "business", None)]
    company = "SC3451191                       00030012FOO LIMITED<".ljust(90)
    #          number  1 app person      Y filler appointed resigned postcode birth   full    len
    officer = "SC345119" + "2" + "1" + "01" + "012345678901" + " " + " " * 7 + "20200131" + " " * 8 + "EC1A 1BB" + "197003  " + " " * 8 + "0060" + "MR<JANE MARY<O'DOE<<<<1 HIGH ST<<LONDON<<UK<ACCOUNTANT<BRITISH<ENGLAND<"
    gone = "SC345119" + "2" + "1" + "00" + "999999999999" + " " + " " * 7 + "20190131" + "20210101" + " " * 8 + "197003  " + "19700304" + "0020" + "<JOHN<ROE<<<<<<<<<<<<"
    corporate = "SC345119" + "2" + "1" + "00" + "888888888888" + "Y" + " " * 7 + "20190131" + " " * 8 + " " * 24 + "0020" + "<<NOMINEES LTD<<<<<<<<<<<<"
    path = lines(tmp_path, "o.dat", "\n".join(["DDDDSNAP0195".ljust(80), company, officer, gone, corporate, "99999999000000003".ljust(80)]))
    got = {r["source_id"]: r for r in R.officers(spark, path).collect()}
    jane, john = got["012345678901"], got["999999999999"]
    assert (jane["name"], jane["known_for_org"], jane["from_date"], jane["to_date"], jane["known_for_role"], jane["person_type"], jane["birth_date"], jane["nationality"]) == ("Jane Mary O'Doe", "FOO LIMITED", "2020-01-31", "", "ACCOUNTANT", "professional", "1970-03", "BRITISH")
    assert (john["known_for_role"], john["to_date"], john["birth_date"]) == ("Director", "2021-01-01", "1970-03-04") and set(got) == {"012345678901", "999999999999"}
    assert [r["source_id"] for r in R.officers(spark, path, current_only=True).collect()] == ["012345678901"]


def test_kinds_of_companies_and_officers(spark):
    rows = spark.createDataFrame([("PRI/LTD BY GUAR/NSC", "Company Secretary"), ("Overseas Entity", "Consultant"), ("Royal Charter Company", "Plumber"), ("Other company type", "Chief Counsel"), ("Limited Partnership", "")], "c string, r string")
    got = rows.select(R.company_kind(rows["c"]).alias("c"), R.officer_kind(rows["r"]).alias("r")).collect()
    assert [tuple(r) for r in got] == [("nonprofit", "legal"), ("business", "professional"), ("business", "executive"), ("unknown", "executive"), (None, "executive")]


def test_role_and_organization_in_text(spark):
    from siftworks.functions.labels import org_in_text, role_in_text

    texts = [("Ann Lee", "Ann Lee, chief people officer of Acme Foods Inc. said."), ("Bo Li", "On Monday Bo Li spoke at Zeta Corp."), ("Cy", "Head of sales"), ("Di Roe", "Foo Bars Di Roe left")]
    rows = spark.createDataFrame(texts, "person string, text string")
    got = rows.select(role_in_text(rows["text"]).alias("r"), org_in_text("person", "text").alias("o")).collect()
    assert [tuple(r) for r in got] == [("chief people officer", "Acme Foods Inc"), (None, "Zeta Corp"), ("Head of sales", None), (None, "Foo Bars")]


def test_wikidata(spark, tmp_path):
    snak = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    pos = lambda role, **q: snak({"id": role}) | {"qualifiers": {p: [{"datavalue": {"value": v}}] for p, v in q.items()}}
    person = {"id": "Q1", "type": "item", "labels": {"en": {"value": "Ann"}}, "claims": {"P31": [snak({"id": "Q5"})], "P569": [snak({"time": "+1950-01-02T00:00:00Z"})],
              "P39": [pos("Q10"), pos("Q11", P580={"time": "+2001-01-01T00:00:00Z"}), pos("Q12", P108={"id": "Q77"}), pos("Q13", P642={"id": "Q78"}, P580={"time": "+2003-01-01T00:00:00Z"})]}}
    org = {"id": "Q2", "type": "item", "labels": {"de": {"value": "Werk"}, "fr": {"value": "Usine"}}, "claims": {"P31": [snak({"id": "Q999"}), snak({"id": "Q4830453"})], "P17": [snak({"id": "Q183"})]}}
    path = lines(tmp_path, "dump.json", "[\n" + json.dumps(person) + ",\n" + json.dumps(org) + "\n{bad\n]\n")
    entities = R.wikidata_entities(spark, path)
    people = R.wikidata_people(entities).collect()
    assert [(r["name"], r["known_for_role"], r["known_for_org"], r["from_date"], r["birth_date"]) for r in people] == [("Ann", "Q13", "Q78", "2003-01-01", "1950-01-02")]
    orgs = R.wikidata_organizations(entities, spark.createDataFrame([("Q4830453", "business")], "kind_qid string, entity_type string")).collect()
    assert [(r["name"], r["entity_type"], r["region"]) for r in orgs] == [("Werk", "business", "Q183")]
    labels = spark.createDataFrame([("Q183", "Germany")], "qid string, label string")
    assert R.resolve_labels(spark.createDataFrame([("Q183",), ("Q9",)], "region string"), ["region"], labels).orderBy("region").collect()[0]["region"] == "Germany"
