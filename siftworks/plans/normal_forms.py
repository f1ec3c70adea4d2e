"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.regions import region_lookup, sql_lookup, with_region
from ..tables import table

c = F.col


def _orgs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organizations")


def n01_clean_org_name(spark, d):
    return _orgs(spark, d).select("id", N.clean_org_name(c("name")).alias("cleaned"))


def n02_remove_suffix(spark, d):
    return _orgs(spark, d).select("id", N.remove_suffix(c("name")).alias("short_name"))


def n03_normalize_org_name(spark, d):
    return _orgs(spark, d).select("id", N.normalize_org_name(c("name")).alias("normalized"))


def n04_canon_name(spark, d):
    return _orgs(spark, d).select("id", N.canon_name(c("name")).alias("canon"))


def n05_expand_suffix(spark, d):
    return _orgs(spark, d).select("id", N.expand_suffix(c("name")).alias("expanded"))


def n06_names_match(spark, d):
    people = table(spark, d, "people").where("known_for_org_id is not null").select(c("id").alias("person_id"), c("known_for_org_id").alias("id"), "known_for_org")
    return people.join(_orgs(spark, d).select("id", "name"), "id").select("person_id", "id", N.names_match(c("known_for_org"), c("name")).alias("same_name"))


def n07_person_name(spark, d):
    return table(spark, d, "people").select("id", N.normalize_person_name(c("name")).alias("normalized"))


def n08_search_terms(spark, d):
    return _orgs(spark, d).select("id", F.array_join(N.search_terms(c("name")), "|").alias("terms"))


def n09_region_iso(spark, d):
    lookup = region_lookup(spark, table(spark, d, "ref_countries"))
    return with_region(_orgs(spark, d).select("id", "region"), "region", lookup).select("id", "iso")


def n10_regions_match(spark, d):
    lookup = region_lookup(spark, table(spark, d, "ref_countries"))
    people = table(spark, d, "people").where("known_for_org_id is not null").select(c("id").alias("person_id"), c("known_for_org_id").alias("id"), "country")
    both = with_region(people.join(_orgs(spark, d).select("id", "region"), "id"), "country", lookup, "a")
    both = with_region(both, "region", lookup, "b")
    return both.select("person_id", ((c("a") == "") | (c("b") == "") | (c("a") == c("b"))).alias("regions_match"))


def n11_qid(spark, d):
    number = N.parse_qid(c("source_id"))
    return _orgs(spark, d).where(c("source_id").rlike("^Q[0-9]")).select("id", number.alias("qid"), N.format_qid(number).alias("text"))


def n12_simple(spark, d):
    return table(spark, d, "locations").select("id", F.lower(F.trim("name")).alias("simple"))


def n13_title_case(spark, d):
    return table(spark, d, "people").select("id", N.title_case(c("name")).alias("titled"))


def n14_compact_date(spark, d):
    return _orgs(spark, d).where("from_date is not null").select("id", N.compact_date(F.replace("from_date", F.lit("-"), F.lit(""))).alias("iso_date"))


def n15_entity_form(spark, d):
    return _orgs(spark, d).select("id", N.entity_form(c("name")).alias("entity"))


def n16_dedup_key(spark, d):
    rows = triples(spark, d)
    key = F.concat_ws("|", N.entity_form(c("subject")), F.lower(F.trim("predicate")), N.entity_form(c("object")))
    return rows.groupBy(key.alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"))


def n17_triple_hash(spark, d):
    return triples(spark, d).select("seq", N.triple_key(c("subject"), c("predicate"), c("object")).alias("triple_hash"))


def n18_xml_escape(spark, d):
    return _orgs(spark, d).select("id", N.xml_escape(c("name")).alias("escaped"))


def n19_citation(spark, d):
    docs = table(spark, d, "documents")
    authors = F.when(c("lang").isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.array(F.coalesce("source", F.lit("anon")), c("lang"), F.lit("staff")), 1, (c("doc_id") % 4).cast("int")))
    return docs.select("doc_id", N.citation(c("title"), authors, F.year("published_at"), (c("doc_id") % 9).cast("int")).alias("citation"))


def n20_qualified_name(spark, d):
    return table(spark, d, "people").select("id", N.qualified_name(c("name"), c("known_for_role"), c("known_for_org"), F.when(F.coalesce("known_for_org", F.lit("")) == "", c("country"))).alias("fqn"))


def n21_org_qualified_name(spark, d):
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in N.ID_PREFIX.items() for x in kv]), c("source"))
    inside = F.concat_ws(",", prefix, F.nullif("region", F.lit("")))
    return _orgs(spark, d).select("id", F.format_string("%s (%s)", F.upper("name"), inside).alias("fqn"))


def n22_canonical_id(spark, d):
    return _orgs(spark, d).select("id", N.canonical_id(c("source"), c("source_id"), c("name")).alias("canonical_id"))


def n23_predicate_category(spark, d):
    """Roles looked up in the role list as written, else in lower case with underscores."""
    key = lambda col: F.regexp_replace(F.lower(col), "[ -]", "_")
    roles = table(spark, d, "ref_roles")
    rows = table(spark, d, "people").select("id", "known_for_role")
    exact = roles.select(c("title").alias("known_for_role"), c("code").alias("c1"))
    loose = roles.select(key(c("title")).alias("k"), c("code").alias("c2"))
    return rows.join(exact, "known_for_role", "left").join(loose, key(c("known_for_role")) == c("k"), "left").select("id", F.coalesce("c1", "c2").alias("category"))


def n24_sentence_count(spark, d):
    return table(spark, d, "documents").select("doc_id", N.sentence_count(c("text")).cast("bigint").alias("sentences"))


def n25_entity_type(spark, d):
    # the kinds of organization that count as such; the others fall back
    kind = F.upper(F.trim("entity_type"))
    return _orgs(spark, d).select("id", F.when(kind.isin("BUSINESS", "FUND", "BRANCH", "NONPROFIT", "MEDIA"), kind).otherwise("UNKNOWN").alias("kind"))


def n26_truncate(spark, d):
    return _orgs(spark, d).select("id", N.truncate_label(c("name"), 20).alias("label"))


def n28_role_contains(spark, d):
    """Does the role's organization contain, or lie in, the organization's name, both in light normal form."""
    light = lambda col: F.trim(F.regexp_replace(F.lower(col), r" (inc|corp|ltd|limited|llc|plc)\.?\z", ""))
    people = table(spark, d, "people").where("known_for_org_id is not null").select(c("id").alias("person_id"), c("known_for_org_id").alias("id"), light(c("known_for_org")).alias("a"))
    both = people.join(_orgs(spark, d).select("id", light(c("name")).alias("b")), "id")
    return both.select("person_id", (F.contains("a", c("b")) | F.contains("b", c("a"))).alias("related"))


def n29_region_location(spark, d):
    """Regions resolved to the locations table by code, three-letter code or name: the smallest location id of that name."""
    lookup = region_lookup(spark, table(spark, d, "ref_countries"))
    coded = with_region(_orgs(spark, d).select("id", "region"), "region", lookup)
    names = table(spark, d, "ref_countries").select(c("code").alias("iso"), F.lower("name").alias("name_normalized"))
    places = table(spark, d, "locations").groupBy("name_normalized").agg(F.min("id").alias("location_id"))
    return coded.join(names, "iso", "left").join(places, "name_normalized", "left").groupBy("iso").agg(F.count(F.lit(1)).alias("orgs"), F.count("location_id").alias("resolved"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Statements taken from people: who, in what role, of what organization."""
    p = table(spark, d, "people")
    return p.where("known_for_org is not null and known_for_role is not null").select(
        c("id").alias("seq"), c("name").alias("subject"), c("known_for_role").alias("predicate"), c("known_for_org").alias("object"),
        F.concat(c("name"), F.lit(" is "), c("known_for_role"), F.lit(" of "), c("known_for_org"), F.lit(".")).alias("source_text"),
        ((c("id") % 97) / F.lit(97.0)).alias("confidence"), c("source"), c("known_for_org_id").alias("org_id"),
    )


SQL_TRIPLES = """triples as (
  select id as seq, name as subject, known_for_role as predicate, known_for_org as object, name || ' is ' || known_for_role || ' of ' || known_for_org || '.' as source_text,
    (id % 97) / 97.0::double as confidence, source, known_for_org_id as org_id
  from people where known_for_org is not null and known_for_role is not null)"""


def _entity(col: str) -> str:
    return N.sql_entity_form(col)


_PREFIX = "case source " + " ".join(f"when '{k}' then '{v}'" for k, v in N.ID_PREFIX.items()) + " else source end"
_ws = lambda col: f"trim(regexp_replace(lower(coalesce({col}, '')), '\\s+', ' ', 'g'))"
_light = lambda col: f"trim(regexp_replace(lower({col}), ' (inc|corp|ltd|limited|llc|plc)\\.?\\z', '', 'g'))"
_esc = "name"
for _raw, _safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _esc = f"replace({_esc}, '{_raw}', '{_safe}')"

ORACLES = {
    "n01_clean_org_name": f"select id, {N.sql_clean_org_name('name')} as cleaned from organizations",
    "n02_remove_suffix": f"select id, {N.sql_remove_suffix('name')} as short_name from organizations",
    "n03_normalize_org_name": f"select id, {N.sql_normalize_org_name('name')} as normalized from organizations",
    "n04_canon_name": f"select id, {N.sql_canon_name('name')} as canon from organizations",
    "n05_expand_suffix": f"select id, {N.sql_expand_suffix('name')} as expanded from organizations",
    "n06_names_match": f"""with m as (select p.id as person_id, o.id, {N.sql_canon_name('p.known_for_org')} as x, {N.sql_canon_name('o.name')} as y from people p join organizations o on o.id = p.known_for_org_id)
      select person_id, id, x = y or {N.sql_expand_suffix('x')} = {N.sql_expand_suffix('y')} as same_name from m""",
    "n07_person_name": f"select id, {N.sql_normalize_person_name('name')} as normalized from people",
    "n08_search_terms": r"""
      with w as (select id, list_filter(regexp_split_to_array(name, '\s+'), lambda x: x <> '') as ws from organizations),
      k as (select id, case when len(ws) > 1 then list_filter(ws, lambda x: length(x) >= 3) else ws end as ws from w),
      t as (select id, u.w, u.i from k, (select unnest(ws) as w, generate_subscripts(ws, 1) as i) as u),
      r as (select *, row_number() over (partition by id order by length(w) desc, i) as n from t)
      select k.id, coalesce(string_agg(r.w, '|' order by r.n), case when k.ws is null then null else '' end) as terms from k left join r on r.id = k.id and r.n <= 3 group by k.id, k.ws""",
    "n09_region_iso": f"with {sql_lookup()} select id, coalesce(iso, '') as iso from organizations left join lookup on lower(trim(region)) = spelling",
    "n10_regions_match": f"""with {sql_lookup()} select p.id as person_id, coalesce(a.iso, '') = '' or coalesce(b.iso, '') = '' or a.iso = b.iso as regions_match
      from people p join organizations o on o.id = p.known_for_org_id left join lookup a on lower(trim(p.country)) = a.spelling left join lookup b on lower(trim(o.region)) = b.spelling""",
    "n11_qid": "select id, try_cast(regexp_replace(trim(source_id), '^[Qq]', '') as bigint) as qid, 'Q' || try_cast(regexp_replace(trim(source_id), '^[Qq]', '') as bigint) as text from organizations where source_id similar to 'Q[0-9].*'",
    "n12_simple": "select id, lower(trim(name)) as simple from locations",
    "n14_compact_date": r"""with t as (select id, trim(replace(from_date, '-', '')) as x from organizations where from_date is not null)
      select id, case when regexp_full_match(x, '\d{8}') then x[1:4] || '-' || x[5:6] || '-' || x[7:8] when regexp_full_match(x, '\d{6}') then x[1:4] || '-' || x[5:6] end as iso_date from t""",
    "n15_entity_form": f"select id, {_entity('name')} as entity from organizations",
    "n16_dedup_key": f"with {SQL_TRIPLES} select {_entity('subject')} || '|' || lower(trim(predicate)) || '|' || {_entity('object')} as dedup_key, count(*) as n from triples group by 1",
    "n17_triple_hash": f"with {SQL_TRIPLES} select seq, substr(sha256({_ws('subject')} || chr(1) || {_ws('predicate')} || chr(1) || {_ws('object')}), 1, 16) as triple_hash from triples",
    "n18_xml_escape": f"select id, {_esc} as escaped from organizations",
    "n19_citation": """with t as (select *, (doc_id % 4)::int as k, coalesce(source, 'anon') as a1 from documents)
      select doc_id, concat_ws(' - ', nullif(title, ''), case when lang is null or k = 0 then null when k = 1 then a1 when k = 2 then a1 || ' & ' || lang else a1 || ' et al.' end,
        year(published_at)::varchar, 'p. ' || (doc_id % 9)::int) as citation from t""",
    "n20_qualified_name": """with q as (select id, name, unnest([nullif(trim(known_for_role), ''), nullif(trim(known_for_org), ''), nullif(trim(case when coalesce(known_for_org, '') = '' then country end), '')]) as q, unnest([1, 2, 3]) as i from people),
      f as (select * from q where q is not null and lower(q) <> lower(name)),
      o as (select id, lower(q), min(i) as i from f group by 1, 2),
      j as (select f.id, string_agg(f.q, ', ' order by f.i) as s from f join o on o.id = f.id and o.i = f.i group by 1)
      select p.id, case when s is null then name else name || ' (' || s || ')' end as fqn from people p left join j using (id)""",
    "n21_org_qualified_name": f"select id, coalesce(upper(name), 'null') || ' (' || concat_ws(',', {_PREFIX}, nullif(region, '')) || ')' as fqn from organizations",
    "n22_canonical_id": f"select id, case when coalesce(source_id, '') = '' then concat_ws(':', source, name) else concat_ws(':', {_PREFIX}, source_id) end as canonical_id from organizations",
    "n23_predicate_category": "select p.id, coalesce(a.code, b.code) as category from people p left join ref_roles a on a.title = p.known_for_role left join ref_roles b on regexp_replace(lower(b.title), '[ -]', '_', 'g') = regexp_replace(lower(p.known_for_role), '[ -]', '_', 'g')",
    "n24_sentence_count": "select doc_id, greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[.!?]+'), lambda s: length(trim(s, ' ')) > 10))) as sentences from documents",
    "n25_entity_type": "select id, case when upper(trim(entity_type)) in ('BUSINESS', 'FUND', 'BRANCH', 'NONPROFIT', 'MEDIA') then upper(trim(entity_type)) else 'UNKNOWN' end as kind from organizations",
    "n26_truncate": "select id, case when length(name) > 20 then substr(name, 1, 17) || '...' else name end as label from organizations",
    "n28_role_contains": f"select p.id as person_id, contains({_light('p.known_for_org')}, {_light('o.name')}) or contains({_light('o.name')}, {_light('p.known_for_org')}) as related from people p join organizations o on o.id = p.known_for_org_id",
    "n29_region_location": f"""with {sql_lookup()}, places as (select name_normalized, min(id) as location_id from locations group by 1)
      select coalesce(k.iso, '') as iso, count(*) as orgs, count(location_id) as resolved from organizations o left join lookup k on lower(trim(region)) = spelling left join ref_countries r on r.code = k.iso
      left join places on places.name_normalized = lower(r.name) group by 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        n01_clean_org_name, n02_remove_suffix, n03_normalize_org_name, n04_canon_name, n05_expand_suffix, n06_names_match, n07_person_name, n08_search_terms, n09_region_iso, n10_regions_match, n11_qid, n12_simple,
        n13_title_case, n14_compact_date, n15_entity_form, n16_dedup_key, n17_triple_hash, n18_xml_escape, n19_citation, n20_qualified_name, n21_org_qualified_name, n22_canonical_id, n23_predicate_category, n24_sentence_count,
        n25_entity_type, n26_truncate, n28_role_contains, n29_region_location,
    )
}
