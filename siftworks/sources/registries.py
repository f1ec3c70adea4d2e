"""Registry files as organizations and people: GLEIF, SEC, Companies House, Wikidata. Parsing only; nothing is downloaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import compact_date, title_case

c = F.col

# --- GLEIF ------------------------------------------------------------------------------------------------------

# Legal entity categories and the kinds of organization they mean.
GLEIF_KINDS = {"GENERAL": "business", "BRANCH": "branch", "FUND": "fund", "SOLE_PROPRIETOR": "business", "RESIDENT_GOVERNMENT_ENTITY": "government", "INTERNATIONAL_ORGANIZATION": "international_org", "": "unknown"}

def _lookup(value: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def gleif_json(raw: DataFrame, column: str, active_only: bool = True) -> DataFrame:
    """Organizations from LEI records in JSON, one a row, in the API's nesting or with names under ``$``; others are dropped."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(c(column), p) for p in paths])
    e = "$.attributes.entity"
    row = raw.select(
        at("$.attributes.lei", "$.lei", "$.LEI['$']", "$.id").alias("source_id"),
        at(f"{e}.legalName.name", "$.Entity.LegalName['$']").alias("name"),
        F.upper(F.coalesce(at(f"{e}.status", "$.Entity.EntityStatus['$']"), F.lit("ACTIVE"))).alias("status"),
        at(f"{e}.category", "$.Entity.EntityCategory['$']").alias("category"),
        F.coalesce(at(f"{e}.legalAddress.country", "$.Entity.LegalAddress.Country['$']"), F.lit("")).alias("region"),
        F.substring(at(f"{e}.creationDate", "$.Entity.EntityCreationDate['$']"), 1, 10).alias("from_date"),
        at(f"{e}.legalAddress.city", "$.Entity.LegalAddress.City['$']").alias("city"),
    )
    return _gleif(row, active_only)


def gleif_lines(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """A file with one LEI record a line; lines that are no record are dropped."""
    return gleif_json(spark.read.text(path), "value", active_only)


def gleif_array(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """A file that holds one JSON array of records, or an object with it under ``data``.

    The parser streams through the array of a file, one record a row; several files are read in parallel. An object is one row.
    """
    # parts that are objects come as their JSON text; the two forms differ by letter case only, so each is read by its own schema
    newer = spark.read.schema("id string, lei string, attributes string, Entity string, data array<string>").json(path, multiLine=True)
    older = spark.read.schema("LEI string, Entity string").json(path, multiLine=True).where("Entity is not null")
    quoted = lambda k: F.concat(F.lit(f'"{k}":"'), c(k), F.lit('"'))
    plain = lambda k: F.concat(F.lit(f'"{k}":'), c(k))
    whole = lambda *parts: F.array(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    rows = newer.where("Entity is null").select(F.explode(F.coalesce("data", whole(quoted("id"), quoted("lei"), plain("attributes")))).alias("value"))
    rows = rows.unionByName(older.select(F.explode(whole(plain("LEI"), plain("Entity"))).alias("value")))
    return gleif_json(rows, "value", active_only)


def gleif_xml(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """LEI-CDF XML, with or without namespace, one ``LEIRecord`` a record."""
    schema = "LEI string, Entity struct<LegalName: struct<_VALUE: string>, EntityStatus: string, EntityCategory: string, LegalAddress: struct<City: string, Country: string>, EntityCreationDate: string>"
    x = spark.read.format("xml").schema(schema).option("rowTag", "LEIRecord").option("ignoreNamespace", "true").load(path)
    row = x.select(c("LEI").alias("source_id"), c("Entity.LegalName._VALUE").alias("name"), F.upper(F.coalesce("Entity.EntityStatus", F.lit("ACTIVE"))).alias("status"), c("Entity.EntityCategory").alias("category"),
                   F.coalesce("Entity.LegalAddress.Country", F.lit("")).alias("region"), F.substring("Entity.EntityCreationDate", 1, 10).alias("from_date"), c("Entity.LegalAddress.City").alias("city"))
    return _gleif(row.withColumn("category", F.coalesce("category", F.lit(""))), active_only)


def _gleif(row: DataFrame, active_only: bool) -> DataFrame:
    kept = row.where((F.length("source_id") == 20) & (F.trim("name") != ""))
    kept = kept.where("status = 'ACTIVE'") if active_only else kept
    record = F.map_filter(F.create_map(F.lit("city"), c("city"), F.lit("status"), c("status"), F.lit("category"), c("category")), lambda k, v: v.isNotNull())
    return kept.select(F.trim("name").alias("name"), F.lit("gleif").alias("source"), "source_id", "region", _lookup(c("category"), GLEIF_KINDS, "business").alias("entity_type"), F.coalesce("from_date", F.lit("")).alias("from_date"), record.alias("record"))


def gleif_file(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """The reader by extension, else by the first character of the file."""
    if path.lower().rstrip("*").endswith(".xml"):
        return gleif_xml(spark, path, active_only)
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    first = head[0]["value"].lstrip()[:1] if head else ""
    if first == "<":
        return gleif_xml(spark, path, active_only)
    is_array = first == "[" or (first == "{" and '"data"' in head[0]["value"][:2000] and '"attributes"' not in head[0]["value"].split('"data"')[0])
    return gleif_array(spark, path, active_only) if is_array else gleif_lines(spark, path, active_only)


# --- SEC --------------------------------------------------------------------------------------------------------

# Industry codes of funds.
FUND_SICS = ("6722", "6726", "6732", "6799")


def sec_tickers(spark: SparkSession, path: str) -> DataFrame:
    """``(cik, ticker, title)`` of a company_tickers file: an object of numbered entries; CIKs with ten digits."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>"))).alias("e"))
    return entries.select(F.lpad("e.cik_str", 10, "0").alias("cik"), "e.ticker", "e.title")


def sec_submissions(raw: DataFrame, column: str, tickers: DataFrame | None = None) -> DataFrame:
    """Organizations from submission documents; kept if operating, a foreign private issuer, listed, or with an industry code."""
    schema = "cik string, name string, entityType string, sic string, tickers array<string>, stateOfIncorporation string, addresses struct<business: struct<stateOrCountry: string, city: string>>, filings struct<recent: struct<filingDate: array<string>>>"
    j = raw.select(F.from_json(c(column), schema).alias("j")).select("j.*").where("cik is not null and trim(name) <> ''").withColumn("cik", F.lpad("cik", 10, "0"))
    own = F.get("tickers", F.lit(0))
    if tickers is not None:
        j = j.join(tickers.groupBy("cik").agg(F.min("ticker").alias("listed")), "cik", "left")
        own = F.coalesce(own, c("listed"))
    j = j.withColumn("ticker", own).where(c("entityType").isin("operating", "foreign-private-issuer") | c("ticker").isNotNull() | (F.coalesce("sic", F.lit("")) != ""))
    dates = c("filings.recent.filingDate")
    record = F.map_filter(F.create_map(F.lit("ticker"), c("ticker"), F.lit("sic"), c("sic"), F.lit("city"), c("addresses.business.city")), lambda k, v: v.isNotNull())
    kind = F.when(c("sic").isin(*FUND_SICS), "fund").otherwise("business")
    return j.select("name", F.lit("sec_edgar").alias("source"), c("cik").alias("source_id"), F.coalesce("addresses.business.stateOrCountry", F.lit("")).alias("region"), kind.alias("entity_type"),
                    F.coalesce(F.get(dates, F.size(dates) - 1), F.lit("")).alias("from_date"), record.alias("record"))


def form_index(spark: SparkSession, path: str) -> DataFrame:
    """``(company, cik, filed, file, accession)`` of the Form 4 lines of a form index."""
    return form_index_lines(spark.read.text(path))


def form_index_lines(text: DataFrame) -> DataFrame:
    """``form_index`` over lines in ``value``."""
    hit = r"^4\s+(.+?)\s+(\d{6,})\s+(\S+)\s+(\S+)\s*$"
    lines = text.where(c("value").rlike(hit))
    part = lambda i: F.regexp_extract("value", hit, i)
    return lines.select(part(1).alias("company"), part(2).alias("cik"), part(3).alias("filed"), part(4).alias("file"), F.regexp_extract("value", r"/(\d+-\d+-\d+)\.txt", 1).alias("accession"))


def form4_owners(raw: DataFrame, column: str) -> DataFrame:
    """One people row per reporting owner of an ``ownershipDocument``; owners without a relationship are dropped."""
    yes = "isDirector: string, isOfficer: string, isTenPercentOwner: string, officerTitle: string"
    schema = f"issuer struct<issuerCik: string, issuerName: string>, periodOfReport string, reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, reportingOwnerRelationship: struct<{yes}>>>"
    x = raw.select(F.from_xml(c(column), schema, {"rowTag": "ownershipDocument"}).alias("x")).select("x.*").withColumn("o", F.explode("reportingOwner"))
    on = lambda f: F.lower(F.trim(c(f"o.reportingOwnerRelationship.{f}"))).isin("1", "true")
    title = F.nullif(F.trim("o.reportingOwnerRelationship.officerTitle"), F.lit(""))
    roles = F.array_compact(F.array(F.when(on("isDirector"), F.lit("Director")), F.when(on("isOfficer"), F.coalesce(title, F.lit("Officer"))), F.when(on("isTenPercentOwner"), F.lit("10% Owner"))))
    bare = lambda col: F.regexp_replace(col, "^0+", "")
    kind = F.when(on("isOfficer") | on("isDirector"), "executive").when(on("isTenPercentOwner"), "entrepreneur").otherwise("unknown")
    return x.withColumn("roles", roles).where(F.size("roles") > 0).select(
        title_case(c("o.reportingOwnerId.rptOwnerName")).alias("name"), F.lit("sec_edgar").alias("source"), F.concat_ws("_", bare(c("o.reportingOwnerId.rptOwnerCik")), bare(c("issuer.issuerCik"))).alias("source_id"),
        F.array_join("roles", ", ").alias("known_for_role"), c("issuer.issuerName").alias("known_for_org"), kind.alias("person_type"), F.coalesce("periodOfReport", F.lit("")).alias("from_date"),
    )


# --- Companies House --------------------------------------------------------------------------------------------

# Beginnings of the company categories that are taken, and what they mean.
CATEGORY_PREFIXES = (
    ("private limited company", "business"),
    ("public limited company", "business"),
    ("private unlimited company", "business"),
    ("limited liability partnership", "business"),
    ("overseas entity", "business"),
    ("old public company", "business"),
    ("royal charter", "business"),
    ("other company type", "unknown"),
    ("pri/ltd by guar", "nonprofit"),
    ("pri/lbg/nsc", "nonprofit"),
    ("community interest company", "nonprofit"),
    ("charitable incorporated organisation", "nonprofit"),
    ("scottish charitable incorporated organisation", "nonprofit"),
    ("registered society", "nonprofit"),
)
# Beginnings of the status of companies that exist.
LIVE_STATUS = ("active", "open", "live")


def company_kind(category: Column) -> Column:
    """The kind of the beginning that fits (no two do); NULL for categories that are left out."""
    bare = F.lower(F.trim(category))
    return F.coalesce(*[F.when(F.startswith(bare, F.lit(p)), F.lit(k)) for p, k in CATEGORY_PREFIXES])


def companies_house_csv(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """Companies of the basic company data file; header names are trimmed, categories taken by their beginning, others dropped."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    names = {n.strip().lstrip("﻿"): n for n in raw.columns}
    get = lambda n: c(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    iso = lambda n: F.coalesce(F.date_format(F.try_to_timestamp(get(n), F.lit("dd/MM/yyyy")), "yyyy-MM-dd"), F.lit(""))
    kind = company_kind(get("CompanyCategory"))
    rows = raw.select(
        get("CompanyName").alias("name"), F.lit("companies_house").alias("source"), get("CompanyNumber").alias("source_id"), F.coalesce(get("CountryOfOrigin"), F.lit("GB")).alias("region"), kind.alias("entity_type"),
        iso("IncorporationDate").alias("from_date"), iso("DissolutionDate").alias("to_date"), F.lower(get("CompanyStatus")).alias("status"), get("SICCode.SicText_1").alias("sic"),
    )
    rows = rows.where("trim(name) <> '' and trim(source_id) <> '' and entity_type is not null")
    rows = rows.where(c("status").rlike("^(" + "|".join(LIVE_STATUS) + ")")) if active_only else rows
    record = F.map_filter(F.create_map(F.lit("status"), c("status"), F.lit("sic"), c("sic")), lambda k, v: v.isNotNull())
    return rows.select("name", "source", "source_id", "region", "entity_type", "from_date", "to_date", record.alias("record"))


# Words in the role of an officer and the kind of person they mean, in order of trial.
OFFICER_WORDS = (
    ("executive", ("director", "ceo", "cfo", "cto", "coo", "chief", "managing", "president", "chairman")),
    ("legal", ("secretary", "solicitor", "lawyer", "legal")),
    ("professional", ("accountant", "engineer", "architect", "doctor", "consultant")),
)


def officer_kind(role: Column) -> Column:
    """Kind of person by words of the role, ``executive`` if none is in it."""
    r = F.lower(role)
    return F.coalesce(*[F.when(r.rlike("|".join(words)), F.lit(kind)) for kind, words in OFFICER_WORDS], F.lit("executive"))


def officers(spark: SparkSession, path: str, current_only: bool = False) -> DataFrame:
    """People of an officers' file of fixed width: company lines (type 1) name the company of the officer lines (type 2).

    Both begin with the company number (columns 1-8) and the type (9); company lines have the name from column 41. Officer lines:
    person number 13-24, ``Y`` in 25 for corporate officers, who are left out, dates CCYYMMDD of appointment 33-40 and
    resignation 41-48, postcode 49-56, birth CCYYMM 57-62 and, if known, CCYYMMDD 65-72, and from 77 fields that end in ``<``:
    title, forenames, surname, honours, care of, box, two lines of address, town, county, country, occupation,
    nationality, country of residence. The role is the occupation, else Director. Lines under 76 characters, header,
    trailer and officers without a surname are skipped. A company's name is joined by its number and needs no order.
    """
    return officer_lines(spark.read.text(path), current_only)


def officer_lines(text: DataFrame, current_only: bool = False) -> DataFrame:
    """``officers`` over lines in ``value``."""
    lines = text.where(~c("value").rlike("^DDDD") & (F.length("value") >= 76))
    cut_ = lambda a, n: F.trim(F.substring("value", a, n))
    companies = lines.where(cut_(9, 1) == "1").groupBy(cut_(1, 8).alias("company_number")).agg(F.max(F.trim(F.regexp_replace(F.expr("substr(value, 41)"), "(?s)<.*", ""))).alias("company"))
    people = lines.where((cut_(9, 1) == "2") & (cut_(25, 1) != "Y")).select(
        cut_(1, 8).alias("company_number"), cut_(13, 12).alias("person"), compact_date(cut_(33, 8)).alias("from_date"), compact_date(cut_(41, 8)).alias("to_date"), cut_(49, 8).alias("postcode"),
        F.coalesce(compact_date(cut_(65, 8)), compact_date(cut_(57, 6)), F.lit("")).alias("birth_date"), F.split(F.expr("substr(value, 77)"), "<").alias("v"),
    )
    part = lambda i: F.trim(F.coalesce(F.get("v", F.lit(i)), F.lit("")))
    role = F.coalesce(F.nullif(part(11), F.lit("")), F.lit("Director"))
    out = people.where(part(2) != "").join(companies, "company_number", "left").select(
        title_case(F.concat_ws(" ", F.nullif(part(1), F.lit("")), part(2))).alias("name"), F.lit("companies_house").alias("source"), c("person").alias("source_id"), role.alias("known_for_role"),
        c("company").alias("known_for_org"), c("company_number"), officer_kind(role).alias("person_type"), part(12).alias("nationality"), "postcode", "birth_date",
        F.coalesce("from_date", F.lit("")).alias("from_date"), F.coalesce("to_date", F.lit("")).alias("to_date"),
    )
    return out.where("to_date = ''") if current_only else out


# --- Wikidata ---------------------------------------------------------------------------------------------------

CLAIM = "struct<mainsnak: struct<datavalue: struct<value: string>>, qualifiers: map<string, array<struct<datavalue: struct<value: string>>>>>"
ENTITY = f"id string, type string, labels map<string, struct<value: string>>, descriptions map<string, struct<value: string>>, sitelinks map<string, string>, claims map<string, array<{CLAIM}>>"


def wikidata_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a dump: a JSON array with one entity a line, plain or compressed; lines that are none are dropped."""
    return wikidata_lines(spark.read.text(path))


def wikidata_lines(text: DataFrame) -> DataFrame:
    """``wikidata_entities`` over lines in ``value``."""
    lines = text.select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("line")).where(~c("line").isin("[", "]", ""))
    return lines.select(F.from_json("line", ENTITY).alias("e")).where("e.id is not null").select("e.*")


def claim_ids(prop: str) -> Column:
    """QIDs of a property's values, in order."""
    values = F.transform(F.coalesce(F.try_element_at("claims", F.lit(prop)), F.array().cast(f"array<{CLAIM}>")), lambda x: F.get_json_object(x["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.array_compact(values)


def claim_date(prop: str) -> Column:
    """The first time of a property, YYYY-MM-DD."""
    values = F.transform(F.coalesce(F.try_element_at("claims", F.lit(prop)), F.array().cast(f"array<{CLAIM}>")), lambda x: F.regexp_extract(F.get_json_object(x["mainsnak"]["datavalue"]["value"], "$.time"), r"^\+*([^T]+)T", 1))
    return F.coalesce(F.get(F.array_compact(values), F.lit(0)), F.lit(""))


def label() -> Column:
    """The English label, else that of the first language in alphabetic order."""
    any_ = F.get(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("k"), e["value"]["value"].alias("v")))), F.lit(0))["v"]
    return F.coalesce(F.try_element_at("labels", F.lit("en"))["value"], any_)


def wikidata_people(entities: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Humans (P31 Q5) with their dates and, of their positions, the best by employer and start: both, employer, start, any; the first of equals."""
    humans = entities.where((c("type") == "item") & F.array_contains(claim_ids("P31"), "Q5"))
    if skip is not None:
        humans = humans.join(skip.select("id"), "id", "left_anti")
    q = lambda x, p: F.try_element_at(x["qualifiers"], F.lit(p))
    org = lambda x: F.coalesce(*[F.get_json_object(F.get(q(x, p), F.lit(0))["datavalue"]["value"], "$.id") for p in ("P108", "P642", "P1001")])
    start = lambda x: F.regexp_extract(F.get_json_object(F.get(q(x, "P580"), F.lit(0))["datavalue"]["value"], "$.time"), r"^\+*([^T]+)T", 1)
    positions = F.transform(F.coalesce(F.try_element_at("claims", F.lit("P39")), F.array().cast(f"array<{CLAIM}>")), lambda x, i: F.struct(
        F.when(org(x).isNotNull() & start(x).isNotNull(), 0).when(org(x).isNotNull(), 1).when(start(x).isNotNull(), 2).otherwise(3).alias("tier"), i.alias("i"),
        F.get_json_object(x["mainsnak"]["datavalue"]["value"], "$.id").alias("role"), org(x).alias("org"), start(x).alias("start")))
    best = F.get(F.array_sort(positions), F.lit(0))
    rows = humans.select(c("id").alias("source_id"), label().alias("name"), claim_date("P569").alias("birth_date"), claim_date("P570").alias("death_date"), F.get(claim_ids("P27"), F.lit(0)).alias("country"), best.alias("p"))
    return rows.where("name is not null").select("name", F.lit("wikidata").alias("source"), "source_id", "country", c("p.role").alias("known_for_role"), F.coalesce("p.org", F.lit("")).alias("known_for_org"), F.coalesce("p.start", F.lit("")).alias("from_date"), "birth_date", "death_date")


def wikidata_organizations(entities: DataFrame, kinds: DataFrame) -> DataFrame:
    """Items whose kinds (P31) are in ``kinds`` (``kind_qid, entity_type``); the first listed kind counts."""
    each = entities.where("type = 'item'").select("id", label().alias("name"), claim_date("P571").alias("from_date"), F.get(claim_ids("P17"), F.lit(0)).alias("region"), F.posexplode(claim_ids("P31")).alias("i", "kind_qid"))
    known = each.join(F.broadcast(kinds), "kind_qid")  # a fixed list of kinds
    first = known.groupBy("id", "name", "from_date", "region").agg(F.min_by("entity_type", "i").alias("entity_type"))
    return first.where("name is not null").select("name", F.lit("wikidata").alias("source"), c("id").alias("source_id"), F.coalesce("region", F.lit("")).alias("region"), "entity_type", "from_date")


def resolve_labels(rows: DataFrame, columns: list[str], labels: DataFrame) -> DataFrame:
    """QIDs in ``columns`` replaced by their label (``qid, label``), kept where there is none."""
    out = rows
    for name in columns:
        out = out.join(labels.select(c("qid").alias(name), c("label").alias("_l")), name, "left").withColumn(name, F.coalesce("_l", name)).drop("_l")
    return out.select(*rows.columns)


def first_binding(bindings: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """SPARQL results ``uri, label, ...`` as rows: ids from the address, labels that are QIDs skipped, each id once, those in ``seen`` left out."""
    rows = bindings.withColumn("source_id", F.regexp_extract("uri", r"/(Q\d+)$", 1)).where("source_id <> '' and label is not null").where(~c("label").rlike(r"^Q\d+$"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("label"))).where("_n = 1").drop("_n")
    return rows if seen is None else rows.join(seen.select("source_id"), "source_id", "left_anti")
