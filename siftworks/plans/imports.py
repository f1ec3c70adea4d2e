"""Queries over the readers (tables written in a registry's form and read back) and over the pipeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import pipeline
from ..functions import normalize as N
from ..functions import vectors as V
from ..operators import store
from ..operators.knn import nearest
from ..operators.statements import numbered_nodes, repair_xml
from ..sources import registries as R
from ..tables import table
from .normal_forms import SQL_TRIPLES, triples

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_CATEGORY = "coalesce(record['category'], 'GENERAL')"
_KIND = "case " + _CATEGORY + " " + " ".join(f"when '{k}' then '{v}'" for k, v in R.GLEIF_KINDS.items()) + " else 'business' end"


@query(f"""select id, trim(name) as name, source_id, {_KIND} as entity_type, coalesce(substr(from_date, 1, 10), '') as from_date from organizations
  where source = 'gleif' and trim(name) <> '' and upper(coalesce(record['status'], 'ACTIVE')) = 'ACTIVE' and length(source_id) = 20 and not contains(name, chr(92))""")
def s06_lei_json(spark, d):
    """GLEIF rows written as LEI records and read back; inactive ones and those without a name are left out."""
    orgs = table(spark, d, "organizations").where(c("source") == "gleif").where(~F.contains("name", F.lit("\\")))
    at = lambda k: F.element_at("record", F.lit(k))
    entity = F.struct(F.struct("name").alias("legalName"), at("status").alias("status"), F.coalesce(at("category"), F.lit("GENERAL")).alias("category"), F.struct(at("city").alias("city"), c("region").alias("country")).alias("legalAddress"), c("from_date").alias("creationDate"))
    raw = orgs.select("id", F.to_json(F.struct(c("id").cast("string").alias("marker"), F.struct(c("source_id").alias("lei"), entity.alias("entity")).alias("attributes"))).alias("j"))
    parsed = R.gleif_json(raw, "j").select("name", "source_id", "entity_type", "from_date", c("record")["category"].alias("cat")).distinct()
    kept = orgs.select("id", "source_id", F.trim("name").alias("name"), F.coalesce(F.substring("from_date", 1, 10), F.lit("")).alias("from_date"), F.coalesce(at("category"), F.lit("GENERAL")).alias("cat"), F.upper(F.coalesce(at("status"), F.lit("ACTIVE"))).alias("st"))
    return kept.where("st = 'ACTIVE'").join(parsed, ["source_id", "name", "from_date", "cat"]).select("id", "name", "source_id", "entity_type", "from_date")


@query("select lpad(source_id, 14, '0') as cik, min(record['ticker']) as ticker from organizations where source = 'sec_edgar' and record['ticker'] is not null group by 1")
def s10_ticker_lookup(spark, d):
    orgs = table(spark, d, "organizations").where((c("source") == "sec_edgar") & F.element_at("record", F.lit("ticker")).isNotNull())
    return orgs.groupBy(F.lpad("source_id", 14, "0").alias("cik")).agg(F.min(F.element_at("record", F.lit("ticker"))).alias("ticker"))


@query("""select id, case when source = 'sec_edgar' and (record['ticker'] is not null or record['sic'] is not null) then case when record['sic'] in ('6722', '6726', '6732', '6799') then 'fund' else 'business' end end as kind from organizations where source = 'sec_edgar'""")
def s11_submission_kind(spark, d):
    orgs = table(spark, d, "organizations").where("source = 'sec_edgar'")
    sic, ticker = F.element_at("record", F.lit("sic")), F.element_at("record", F.lit("ticker"))
    return orgs.select("id", F.when(ticker.isNotNull() | sic.isNotNull(), F.when(sic.isin(*R.FUND_SICS), "fund").otherwise("business")).alias("kind"))


_CASES = "case id % 7 when 0 then 'Private Limited Company' when 1 then 'PRI/LTD BY GUAR/NSC (Private, limited by guarantee, no share capital)' when 2 then 'Charitable Incorporated Organisation' when 3 then 'Overseas Entity' when 4 then 'Royal Charter Company' when 5 then 'Other company type' else 'Limited Partnership' end"
_WHENS = " ".join(f"when starts_with(lower(cat), '{p}') then '{k}'" for p, k in R.CATEGORY_PREFIXES)


@query(f"with t as (select id, {_CASES} as cat from organizations where source = 'companies_house') select id, case {_WHENS} end as kind from t")
def s13_company_kind(spark, d):
    return table(spark, d, "organizations").where("source = 'companies_house'").select("id", R.company_kind(F.expr(_CASES)).alias("kind"))


@query(r"""with p as (select *, regexp_replace(replace(coalesce(name, ''), '<', ' '), '\s+', ' ', 'g') as n, regexp_replace(replace(coalesce(known_for_role, ''), '<', ' '), '\s+', ' ', 'g') as o from people where source = 'companies_house')
  select id, upper(trim(n)) as name_upper, coalesce(nullif(trim(o), ''), 'Director') as known_for_role, 'COMPANY ' || lpad((id % 100000000)::varchar, 8, '0') as known_for_org,
    case when regexp_full_match(from_date, '\d{4}-\d{2}-\d{2}') then from_date else '' end as from_date, case when regexp_full_match(to_date, '\d{4}-\d{2}-\d{2}') then to_date else '' end as to_date,
    case when regexp_full_match(birth_date, '\d{4}-\d{2}(-\d{2})?') then birth_date else '' end as birth_date from p where trim(n) <> ''""")
def s16_officers(spark, d):
    """All people of that source as lines of the file's specification, between company lines, corporate officers, header and trailer, and read back."""
    flat = lambda k: F.trim(F.regexp_replace(F.replace(F.coalesce(k, F.lit("")), F.lit("<"), F.lit(" ")), r"\s+", " "))
    p = table(spark, d, "people").where("source = 'companies_house'").withColumn("n", flat("name")).withColumn("o", flat("known_for_role"))
    number = F.lpad((c("id") % 100000000).cast("string"), 8, "0")
    day = lambda k: F.when(c(k).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(k, F.lit("-"), F.lit(""))).otherwise(F.repeat(F.lit(" "), F.lit(8)))
    month = F.when(c("birth_date").rlike(r"^\d{4}-\d{2}$"), F.replace("birth_date", F.lit("-"), F.lit(""))).otherwise(F.repeat(F.lit(" "), F.lit(6)))
    fields = F.concat(F.lit("MR<"), F.regexp_replace("n", r"\s*\S+$", ""), F.lit("<"), F.regexp_extract("n", r"(\S+)$", 1), F.lit("<<<<<<<<<"), c("o"), F.lit("<BRITISH<ENGLAND<"))
    line = lambda corporate: F.concat(number, F.lit("2101"), F.lpad(c("id").cast("string"), 12, "0"), F.lit(corporate), F.lit(" " * 7), day("from_date"), day("to_date"), F.rpad(F.lit("AB1 2CD"), 8, " "), month, F.lit("  "), day("birth_date"), F.lit("0100"), fields)
    companies = p.select(F.concat(number, F.lit("1"), F.lit(" " * 23), F.lit("00010020COMPANY "), number, F.lit("<" + " " * 30)).alias("value"))
    header = spark.createDataFrame([("DDDDSNAP0195" + " " * 80,), ("9999" + "0" * 90,)], "value string")
    lines = companies.unionByName(p.select(line(" ").alias("value"))).unionByName(p.select(line("Y").alias("value"))).unionByName(header)
    return R.officer_lines(lines).select(F.ltrim("source_id", F.lit("0")).cast("bigint").alias("id"), F.upper("name").alias("name_upper"), "known_for_role", "known_for_org", "from_date", "to_date", "birth_date")


_OFFICER = "case " + " ".join(f"when regexp_matches(lower(known_for_role), '{'|'.join(words)}') then '{kind}'" for kind, words in R.OFFICER_WORDS) + " else 'executive' end"


@query(f"select id, {_OFFICER} as kind from people where known_for_role is not null")
def s18_officer_kind(spark, d):
    return table(spark, d, "people").where("known_for_role is not null").select("id", R.officer_kind(c("known_for_role")).alias("kind"))


@query(r"""select id, regexp_extract(name, '^\s*(.*?)\s*$', 1) as company, lpad(right(source_id, 10), 10, '0') as cik from organizations where source = 'sec_edgar' and regexp_full_match(name, '[A-Z][A-Za-z]+ [A-Za-z ]+[A-Za-z.]') and not regexp_matches(name, '\s\s')""")
def s19_form_index(spark, d):
    ok = c("name").rlike(r"^[A-Z][A-Za-z]+ [A-Za-z ]+[A-Za-z.]$") & ~c("name").rlike(r"\s\s")
    orgs = table(spark, d, "organizations").where((c("source") == "sec_edgar") & ok)
    cik = F.lpad(F.expr("right(source_id, 10)"), 10, "0")
    lines = orgs.select(F.concat(F.lit("4          "), c("name"), F.lit("        "), cik, F.lit("   2024-01-02  edgar/data/"), c("id"), F.lit("/"), c("id"), F.lit("-24-1.txt")).alias("value"))
    parsed = R.form_index_lines(lines)
    return parsed.select(F.split_part("accession", F.lit("-"), F.lit(1)).cast("bigint").alias("id"), "company", "cik")


@query("""select id, name, 'Q' || (id % 1000) as country, birth_date from people where source = 'wikidata' and not contains(name, chr(92)) and name is not null""")
def s24_wikidata_people(spark, d):
    """People written as entities of a dump and read back."""
    people = table(spark, d, "people").where("source = 'wikidata' and name is not null").where(~F.contains("name", F.lit("\\")))
    claim = lambda v: F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    born = F.when(F.coalesce("birth_date", F.lit("")) != "", F.array(claim(F.struct(F.concat(F.lit("+"), "birth_date", F.lit("T00:00:00Z")).alias("time")))))
    claims = F.struct(F.array(claim(F.struct(F.lit("Q5").alias("id")))).alias("P31"), born.alias("P569"), F.array(claim(F.struct(F.concat(F.lit("Q"), c("id") % 1000).alias("id")))).alias("P27"))
    line = F.to_json(F.struct(F.concat(F.lit("Q"), "id").alias("id"), F.lit("item").alias("type"), F.struct(F.struct(c("name").alias("value")).alias("en")).alias("labels"), claims.alias("claims")))
    found = R.wikidata_people(R.wikidata_lines(people.select(F.concat(line, F.lit(",")).alias("value"))))
    births = people.select("id", c("birth_date").alias("b"))
    out = found.select(N.parse_qid(c("source_id")).alias("id"), "name", "country", "birth_date").join(births, "id")
    return out.select("id", "name", "country", F.when(c("b").isNotNull(), c("birth_date")).alias("birth_date"))


@query(r"select id, regexp_extract('+' || from_date || 'T00:00:00Z', '^\+*([^T]+)T', 1) as day from people where from_date <> ''")
def s29_time_value(spark, d):
    return table(spark, d, "people").where("from_date <> ''").select("id", F.regexp_extract(F.concat(F.lit("+"), "from_date", F.lit("T00:00:00Z")), r"^\+*([^T]+)T", 1).alias("day"))


@query("""select known_for_org_id as org_id, arg_min(id, ((case when known_for_role <> '' and from_date <> '' then 0 when known_for_role <> '' then 1 when from_date <> '' then 2 else 3 end), id)) as person_id from people where known_for_org_id is not null group by 1""")
def s31_best_by_tier(spark, d):
    """For each organization the first person with role and date, else with a role, else with a date, else any."""
    has = lambda x: F.coalesce(c(x) != "", F.lit(False))
    tier = F.when(has("known_for_role") & has("from_date"), 0).when(has("known_for_role"), 1).when(has("from_date"), 2).otherwise(3)
    people = table(spark, d, "people").where("known_for_org_id is not null").select(c("known_for_org_id").alias("org_id"), "id", tier.alias("tier"))
    return people.groupBy("org_id").agg(F.min_by("id", F.struct("tier", "id")).alias("person_id"))


@query("select distinct known_for_org as name from people where known_for_org <> '' and known_for_org not in (select name from organizations where name is not null)")
def s35_discovered_orgs(spark, d):
    known = table(spark, d, "organizations").where("name is not null").select("name")
    return table(spark, d, "people").where("known_for_org <> ''").select(c("known_for_org").alias("name")).distinct().join(known, "name", "left_anti")


@query(r"select regexp_extract('http://x/entity/' || source_id, '/(Q\d+)$', 1) as source_id, min(name) as label from organizations where regexp_full_match(source_id, 'Q\d+') and name is not null and not regexp_full_match(name, 'Q\d+') group by 1")
def s37_bindings(spark, d):
    rows = table(spark, d, "organizations").where(c("source_id").rlike(r"^Q\d+$")).select(F.concat(F.lit("http://x/entity/"), "source_id").alias("uri"), c("name").alias("label"))
    return R.first_binding(rows).select("source_id", "label")


@query(f"with {SQL_TRIPLES} select seq, 1 as statements from triples where trim(subject) <> ''")
def s53_repair_xml(spark, d):
    """Statements cut off in the middle of a second one, repaired: the whole one stays."""
    from ..operators.statements import to_xml

    rows = triples(spark, d).where("trim(subject) <> ''")
    cut_off = F.concat(F.lit("<statements>"), to_xml(c("subject"), c("predicate"), c("object"), c("source_text")), F.lit("<stmt><subject>A & B"))
    fixed = repair_xml(cut_off)
    return rows.select("seq", F.regexp_count(fixed, F.lit("<stmt>.*?</stmt></statements>")).alias("statements"))


# --- pipeline ---------------------------------------------------------------------------------------------------


@query()
def r29_pipeline(spark, d):
    """The whole pipeline over all documents with the stand-in parts."""
    return pipeline.run(table(spark, d, "documents")).select("doc_id", "sentence_no", "subject", "predicate", "object", F.size("labels").alias("labels"))


@query("select doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: trim(s, ' ')), lambda s: regexp_matches(s, '\\pL'))) as sentences from documents where text is not null")
def r29_sentences(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(pipeline.split_sentences(c("text"))).cast("bigint").alias("sentences"))


@query(f"""with {SQL_TRIPLES} select seq, predicate as label_value, confidence >= 0.5 as sure from triples where predicate <> ''""")
def l03_relation_label(spark, d):
    return triples(spark, d).where("predicate <> ''").select("seq", c("predicate").alias("label_value"), (c("confidence") >= 0.5).alias("sure"))


@query(f"""with {SQL_TRIPLES} select object, arg_max(seq, (confidence + case when org_id is not null then 0.2 else 0 end + case when contains(source_text, subject) then 0.2 else 0 end, -seq)) as seq from triples where object <> '' group by 1""")
def l15_refined_triples(spark, d):
    score = c("confidence") + F.when(c("org_id").isNotNull(), 0.2).otherwise(0.0) + F.when(F.contains("source_text", c("subject")), 0.2).otherwise(0.0)
    return triples(spark, d).where("object <> ''").groupBy("object").agg(F.max_by("seq", F.struct(score.alias("s"), (-c("seq")).alias("o"))).alias("seq"))


@query(f"""with {SQL_TRIPLES} select seq, 'hybrid' as method, subject as text from triples union all select seq, 'pattern', lower(subject) from triples where lower(subject) <> subject""")
def l16_candidate_rows(spark, d):
    rows = triples(spark, d)
    both = F.array(F.struct(F.lit("hybrid").alias("method"), c("subject").alias("text")), F.struct(F.lit("pattern").alias("method"), F.lower("subject").alias("text")))
    each = rows.select("seq", "subject", F.explode(both).alias("r"))
    return each.where((c("r.method") == "hybrid") | (c("r.text") != c("subject"))).select("seq", "r.*")


@query()
def v10_hash_embedding(spark, d):
    return table(spark, d, "organizations").select("id", F.size(pipeline.hash_embedding(c("name"))).alias("width"))


@query("select o.id from organizations o where o.id not in (select vec_id from embeddings where vec_id % 2 = 0) and o.id in (select vec_id from embeddings)")
def v11_backfill(spark, d):
    """Organizations with a float vector and none in the quantized table, here the even half."""
    e = table(spark, d, "embeddings").select(c("vec_id").alias("id"))
    return table(spark, d, "organizations").select("id").join(e, "id", "left_semi").join(e.where("id % 2 = 0"), "id", "left_anti")


@query()
def v14_greedy_dedup(spark, d):
    rows = triples(spark, d).withColumn("embedding", pipeline.hash_embedding(c("predicate"), 32))
    return pipeline.greedy_dedup(rows).select("seq")


@query("select vec_id, round(1 / (1 + exp(-25.0 * ((list_sum(list_transform(embedding, lambda x: x::double)) / 64 + 1) / 2 - 0.65))), 6) as calibrated from embeddings")
def v18_calibrated_product(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.calibrated(total / 64), 6).alias("calibrated"))


@query("select label, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as mean_norm from embeddings group by 1")
def a11_mean_by_label(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(V.norm(c("embedding"))), 6).alias("mean_norm"))


@query("select doc_id, p.i as page, length(p.t) as chars from documents, lateral (select unnest(string_split(text, chr(12))) as t, generate_subscripts(string_split(text, chr(12)), 1) as i) p where length(trim(p.t)) > 0")
def f07_by_page(spark, d):
    """The pages of every document, numbered from 1; pages end at page breaks, blank ones are left out."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\f")).alias("i", "t"))
    return pages.where(F.length(F.trim("t")) > 0).select("doc_id", (c("i") + 1).cast("bigint").alias("page"), F.length("t").cast("bigint").alias("chars"))


@query("select id, record['city'] as city from organizations where record['city'] is not null")
def f08_label_of_type(spark, d):
    return table(spark, d, "organizations").select("id", F.element_at("record", F.lit("city")).alias("city")).where("city is not null")


@query("""with recursive link as (select distinct l.id as child, p.p as parent from locations l, unnest(l.parent_ids) as p(p) where p.p in (select id from locations)), reach as (select child, parent from link union select r.child, l.parent from reach r join link l on l.child = r.parent)
  select parent as id, count(*) as descendants from reach where child <> parent and parent in (select id from locations where lower(trim(simplified_type)) = 'country') and parent not in (select child from reach where child = parent) group by 1""")
def g04_country_descendants(spark, d):
    """Countries with the number of places below them, those under circles included."""
    from ..operators.hierarchy import hierarchy, parent_links

    places = table(spark, d, "locations")
    tree = hierarchy(places)
    countries = places.where(F.lower(F.trim("simplified_type")) == "country").select("id")
    plain = tree.where("status = 'tree'").join(countries, "id", "left_semi").select("id", "n_descendants")
    # places below circles hang below countries too: walk down from the countries to them
    _, links = parent_links(places)
    bad = tree.where("status <> 'tree'").select(c("id").alias("child"))
    ways = paths_to(tree, links, bad)
    extra = ways.join(countries.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").groupBy(c("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    below = countries.join(tree.where("status = 'below_cycle'").select("id"), "id", "left_semi").withColumn("n_descendants", F.lit(0).cast("bigint"))
    out = plain.unionByName(below).join(extra, "id", "left").select("id", (c("n_descendants") + F.coalesce("more", F.lit(0))).alias("descendants"))
    return out.where("descendants > 0")


def paths_to(tree, links, bad):
    """``(ancestor, child)`` for the nodes on or below circles: their parents' ancestors, step by step until nothing is new."""
    from ..operators.hierarchy import paths
    from ..tables import cut

    above = paths(tree).select(c("id").alias("parent"), F.explode("path").alias("ancestor"))
    start = links.join(bad, "child", "left_semi")
    found = cut(start.join(above, "parent").select("ancestor", "child").union(start.select(c("parent").alias("ancestor"), "child")).distinct())
    new = found
    inner = cut(start.join(bad.withColumnRenamed("child", "parent"), "parent", "left_semi"))
    while True:
        step = inner.join(new.withColumnRenamed("child", "parent"), "parent").select("ancestor", "child").distinct().join(found, ["ancestor", "child"], "left_anti")
        new = cut(step)
        if new.isEmpty():
            return found.where("ancestor <> child")
        found = cut(found.unionByName(new), replaces=found)


@query("select id, coalesce(nullif(region, ''), nullif(record['city'], ''), 'unknown') as place from organizations")
def r27_first_known(spark, d):
    return table(spark, d, "organizations").select("id", F.coalesce(F.nullif("region", F.lit("")), F.nullif(F.element_at("record", F.lit("city")), F.lit("")), F.lit("unknown")).alias("place"))


@query(r"""with t as (select id, 'NAME: ' || name || chr(10) || 'ROLE: ' || coalesce(nullif(known_for_role, ''), 'NONE') as answer from people where name is not null)
  select id, nullif(trim(regexp_extract(answer, '(?m)^ROLE:[ \t]*(.*)$', 1)), 'NONE') as role from t""")
def r31_answer_lines(spark, d):
    """Answers of a model in lines NAME:, ROLE: read; NONE is none."""
    people = table(spark, d, "people").where("name is not null").select("id", F.concat(F.lit("NAME: "), "name", F.lit("\nROLE: "), F.coalesce(F.nullif("known_for_role", F.lit("")), F.lit("NONE"))).alias("answer"))
    return people.select("id", F.nullif(F.trim(F.regexp_extract("answer", r"(?m)^ROLE:[ \t]*(.*)$", 1)), F.lit("NONE")).alias("role"))


@query("select lower(name) as name, arg_max(record['ticker'], id) as ticker from organizations where record['ticker'] is not null group by 1")
def r34_ticker_cache(spark, d):
    listed = table(spark, d, "organizations").select("id", F.lower("name").alias("name"), F.element_at("record", F.lit("ticker")).alias("ticker")).where("ticker is not null")
    return listed.groupBy("name").agg(F.max_by("ticker", "id").alias("ticker"))


@query("select source, id, name, row_number() over (partition by source order by id) as nth from organizations")
def r16_by_source(spark, d):
    """The rows of each source in the order of their ids."""
    by = Window.partitionBy("source").orderBy("id")
    return table(spark, d, "organizations").select("source", "id", "name", F.row_number().over(by).alias("nth"))


@query("select qid, arg_max(name, id) as label from locations where qid is not null group by 1")
def r17_label_upsert(spark, d):
    places = table(spark, d, "locations").where("qid is not null").select("qid", c("name").alias("label"), "id")
    return store.last_of_each(places, ["qid"], [c("id")]).select("qid", "label")


@query("select name_normalized, max(id) as id from locations group by 1")
def r18_location_cache(spark, d):
    return table(spark, d, "locations").groupBy("name_normalized").agg(F.max("id").alias("id"))


@query("select distinct source_identifier from locations where source_identifier is not null")
def r19_location_source_ids(spark, d):
    return table(spark, d, "locations").select("source_identifier").where("source_identifier is not null").distinct()


@query(f"with {SQL_TRIPLES} select seq, trim(regexp_replace(lower(source_text), '\\s+', ' ', 'g')) as text from triples")
def r36_text_form(spark, d):
    return triples(spark, d).select("seq", F.trim(F.regexp_replace(F.lower("source_text"), r"\s+", " ")).alias("text"))


@query(f"with {SQL_TRIPLES}, f as (select entity, min(seq) as first_seq from (select seq, subject as entity from triples union all select seq, object from triples) group by 1) select entity, row_number() over (order by first_seq, encode(entity)) - 1 as node from f")
def w10_node_numbers(spark, d):
    return numbered_nodes(triples(spark, d))


@query(f"with {SQL_TRIPLES} select subject || '|||' || predicate || '|||' || object as triple, min(seq) as seq from triples group by 1")
def w05_text_dedup(spark, d):
    return triples(spark, d).groupBy(F.concat_ws("|||", "subject", "predicate", "object").alias("triple")).agg(F.min("seq").alias("seq"))


@query(f"with {SQL_TRIPLES}, r as (select source, seq, confidence, row_number() over (partition by source order by confidence desc, seq) as k from triples) select source, seq from r where k <= 20 and confidence >= 0.3")
def t08_top_labels(spark, d):
    ranked = triples(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "seq")))
    return ranked.where("k <= 20 and confidence >= 0.3").select("source", "seq")


@query("select id, name, source, source_id, case source when 'gleif' then 1 when 'sec_edgar' then 2 when 'companies_house' then 3 else 4 end as source_type_id from organizations")
def x11_migrate(spark, d):
    """Rows of the older form with the number of their source type."""
    number = F.when(c("source") == "gleif", 1).when(c("source") == "sec_edgar", 2).when(c("source") == "companies_house", 3).otherwise(4)
    return table(spark, d, "organizations").select("id", "name", "source", "source_id", number.alias("source_type_id"))


@query("select id, name from organizations where source = 'gleif' and source_id in (select min(source_id) from organizations where source = 'gleif')")
def x14_lookup(spark, d):
    gleif = table(spark, d, "organizations").where("source = 'gleif'").select("id", "name", "source_id")
    return gleif.join(F.broadcast(gleif.agg(F.min("source_id").alias("source_id"))), "source_id", "left_semi").select("id", "name")
