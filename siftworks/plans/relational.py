"""Queries over joins, aggregations, windows, set operations and writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import normalize as N
from ..functions.regions import region_lookup, sql_lookup, with_region
from ..operators import store
from ..operators.graph import connected_components, pick_canonical, star_edges
from ..tables import cut, table
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


def _priority(column, ranks):
    pairs = [F.lit(x) for kv in ranks.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(schema.OTHER_PRIORITY))


def _sql_priority(column, ranks):
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in ranks.items()) + f" else {schema.OTHER_PRIORITY} end"


_SOURCES = "(values " + ", ".join(f"({i}, '{n}')" for i, n in schema.SOURCE_TYPES) + ") as st(source_type_id, source_type)"

# --- filters ----------------------------------------------------------------------------------------------------


@query("""with terms as (select unnest(['energy', 'capital', 'water']) as term)
  select id, name_normalized from organizations where exists (select 1 from terms where contains(name_normalized, term)) order by id limit 5000""")
def f01_text_prefilter(spark, d):
    orgs = table(spark, d, "organizations").select("id", "name_normalized")
    hit = F.exists(F.array(*map(F.lit, ("energy", "capital", "water"))), lambda t: F.contains(c("name_normalized"), t))
    return orgs.where(hit).orderBy("id").limit(5000)  # the feature: a candidate list of bounded size


@query("select id, source_id from organizations where regexp_matches(source_id, '^Q[0-9]')")
def f02_qid_shaped(spark, d):
    return table(spark, d, "organizations").where(c("source_id").rlike("^Q[0-9]")).select("id", "source_id")


@query(f"with {SQL_TRIPLES} select seq from triples where coalesce(confidence, 0) >= 0.6")
def f03_confident(spark, d):
    return triples(spark, d).where(F.coalesce("confidence", F.lit(0.0)) >= 0.6).select("seq")


@query(f"""with {SQL_TRIPLES} select seq from triples where source_text is null
  or len(list_filter(regexp_split_to_array(lower(predicate), '\\s+'), lambda w: length(w) > 2 and contains(lower(source_text), w))) > 0""")
def f04_lexical_support(spark, d):
    words = F.filter(F.split(F.lower("predicate"), r"\s+"), lambda w: F.length(w) > 2)
    return triples(spark, d).where(c("source_text").isNull() | F.exists(words, lambda w: F.contains(F.lower("source_text"), w))).select("seq")


@query(f"with {SQL_TRIPLES} select seq, round(confidence, 6) as confidence from triples where confidence >= 0.75 order by confidence desc, seq")
def f06_relations_by_confidence(spark, d):
    return triples(spark, d).where("confidence >= 0.75").orderBy(F.desc("confidence"), "seq").select("seq", F.round("confidence", 6).alias("confidence"))


@query(f"with {SQL_TRIPLES} select count(*) filter (confidence >= 0.85) as high, count(*) filter (confidence >= 0.8) as good, count(*) filter (confidence >= 0.7) as fair from triples")
def f09_confidence_bands(spark, d):
    return triples(spark, d).agg(F.count_if(c("confidence") >= 0.85).alias("high"), F.count_if(c("confidence") >= 0.8).alias("good"), F.count_if(c("confidence") >= 0.7).alias("fair"))


@query(f"select id, {N.sql_normalize_org_name('name')} as name_normalized from organizations where name_normalized is null or name_normalized in ('', '-')")
def f11_backfill_normalized(spark, d):
    missing = c("name_normalized").isNull() | c("name_normalized").isin("", "-")
    return table(spark, d, "organizations").where(missing).select("id", N.normalize_org_name(c("name")).alias("name_normalized"))


# --- joins ------------------------------------------------------------------------------------------------------


@query(f"""select o.id, o.name, st.source_type_id, coalesce(r.name, o.region) as region_name from organizations o
  join {_SOURCES} on st.source_type = case o.source when 'wikipedia' then 'wikidata' else o.source end left join ref_countries r on r.code = o.region""")
def j01_organizations_view(spark, d):
    orgs = table(spark, d, "organizations").withColumn("source_type", F.when(c("source") == "wikipedia", "wikidata").otherwise(c("source")))
    regions = table(spark, d, "ref_countries").select(c("code").alias("region"), c("name").alias("listed"))
    return (
        orgs.join(F.broadcast(schema.source_types(spark)), "source_type").join(F.broadcast(regions), "region", "left")
        .select("id", "name", "source_type_id", F.coalesce("listed", "region").alias("region_name"))
    )


@query(f"""select p.id, st.source_type_id, r.code as role_code, k.name as country_name, o.name as org_name from people p join {_SOURCES} on st.source_type = p.source
  left join ref_roles r on r.title = p.known_for_role left join ref_countries k on k.code = p.country left join organizations o on o.id = p.known_for_org_id""")
def j02_people_view(spark, d):
    people = table(spark, d, "people").select("id", c("source").alias("source_type"), c("known_for_role").alias("title"), c("country").alias("code"), "known_for_org_id")
    roles = table(spark, d, "ref_roles").select("title", c("code").alias("role_code"))
    countries = table(spark, d, "ref_countries").select("code", c("name").alias("country_name"))
    orgs = table(spark, d, "organizations").select(c("id").alias("known_for_org_id"), c("name").alias("org_name"))
    out = people.join(F.broadcast(schema.source_types(spark)), "source_type").join(F.broadcast(roles), "title", "left").join(F.broadcast(countries), "code", "left")
    return out.join(orgs, "known_for_org_id", "left").select("id", "source_type_id", "role_code", "country_name", "org_name")


@query(f"""select 'role' as kind, r.id, r.name, st.source_type from role_records r join {_SOURCES} on st.source_type_id = r.source_id
  union all select 'location', l.id, l.name, st.source_type from locations l join {_SOURCES} on st.source_type_id = l.source_id""")
def j03_roles_locations_view(spark, d):
    kinds = F.broadcast(schema.source_types(spark).withColumnRenamed("source_type_id", "source_id"))
    view = lambda t, k: table(spark, d, t).join(kinds, "source_id").select(F.lit(k).alias("kind"), "id", "name", "source_type")
    return view("role_records", "role").unionByName(view("locations", "location"))


@query("select id, name, map_keys(record)[1] as first_key from organizations where source = 'gleif'")
def j04_view_record(spark, d):
    return table(spark, d, "organizations").where("source = 'gleif'").select("id", "name", F.get(F.map_keys("record"), F.lit(0)).alias("first_key"))


@query("select e.vec_id, o.name from embeddings e join organizations o on o.id = e.vec_id where o.source = 'gleif'")
def j05_vectors_of_source(spark, d):
    orgs = table(spark, d, "organizations").where("source = 'gleif'").select(c("id").alias("vec_id"), "name")
    return table(spark, d, "embeddings").select("vec_id").join(orgs, "vec_id")


@query("select vec_id, label from embeddings where vec_id in (select id from organizations where contains(name_normalized, 'energy'))")
def j06_vectors_of_candidates(spark, d):
    wanted = table(spark, d, "organizations").where(F.contains("name_normalized", F.lit("energy"))).select(c("id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(wanted, "vec_id", "left_semi")


@query("select id from organizations where id not in (select vec_id from embeddings)")
def j07_missing_embeddings(spark, d):
    return table(spark, d, "organizations").select("id").join(table(spark, d, "embeddings").select(c("vec_id").alias("id")), "id", "left_anti")


@query("select id, canon_id from role_records r where canon_id is not null and exists (select 1 from role_records x where x.canon_id = r.canon_id and x.id <> r.id)")
def j08_canon_members(spark, d):
    roles = table(spark, d, "role_records").where("canon_id is not null").select("id", "canon_id")
    several = roles.groupBy("canon_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("canon_id")
    return roles.join(several, "canon_id", "left_semi").select("id", "canon_id")


@query("select canon_id, string_agg(distinct source_id::varchar, ',' order by source_id::varchar) as sources from role_records where canon_id is not null group by 1")
def j09_canon_sources(spark, d):
    roles = table(spark, d, "role_records").where("canon_id is not null")
    return roles.groupBy("canon_id").agg(F.array_join(F.array_sort(F.collect_set(c("source_id").cast("string"))), ",").alias("sources"))


@query("""with k as (select lpad(source_id, 14, '0') as cik, min(id) as org_id from organizations where source = 'sec_edgar' group by 1)
  select p.id, k.org_id from people p left join k on k.cik = lpad(split_part(p.source_id, '_', 1), 14, '0') where p.source = 'sec_edgar'""")
def j10_officer_org(spark, d):
    orgs = table(spark, d, "organizations").where("source = 'sec_edgar'").groupBy(F.lpad("source_id", 14, "0").alias("cik")).agg(F.min("id").alias("org_id"))
    people = table(spark, d, "people").where("source = 'sec_edgar'").select("id", F.lpad(F.split_part("source_id", F.lit("_"), F.lit(1)), 14, "0").alias("cik"))
    return people.join(orgs, "cik", "left").select("id", "org_id")


@query("""with labels as (select qid, min(name) as label from locations where qid is not null group by 1), v as (select id, source_identifier, name, coalesce(l.label, source_identifier) as resolved
    from locations left join labels l on l.qid = try_cast(regexp_replace(source_identifier, '^[Qq]', '') as bigint) where source_identifier is not null)
  select resolved, min(id) as id from v group by 1""")
def j11_resolve_labels(spark, d):
    """QID identifiers replaced by their label; of rows that become equal the first stays."""
    places = table(spark, d, "locations")
    labels = places.where("qid is not null").groupBy("qid").agg(F.min("name").alias("label"))
    rows = places.where("source_identifier is not null").select("id", "source_identifier", N.parse_qid(c("source_identifier")).alias("qid"))
    return rows.join(labels, "qid", "left").groupBy(F.coalesce("label", "source_identifier").alias("resolved")).agg(F.min("id").alias("id"))


@query("""with p as (select l.id, u.p, u.i from locations l, (select unnest(l.parent_ids) as p, generate_subscripts(l.parent_ids, 1) as i) as u),
  k as (select p.id, x.qid, min(i) as i from p join locations x on x.id = p.p where x.qid is not null group by 1, 2)
  select id, string_agg('Q' || qid, ',' order by i) as parent_qids from k group by 1""")
def j12_parent_qids(spark, d):
    """Parent ids as QIDs, in order, each once."""
    places = table(spark, d, "locations")
    links = places.select("id", F.posexplode("parent_ids").alias("i", "p"))
    named = links.join(places.where("qid is not null").select(c("id").alias("p"), "qid"), "p").groupBy("id", "qid").agg(F.min("i").alias("i"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "qid")))
    return named.groupBy("id").agg(F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("Q"), s["qid"])), ",").alias("parent_qids"))


@query("""with m as (select source, source_id, min(id) as new_id from organizations group by 1, 2)
  select p.id, m.new_id from people p join organizations o on o.id = p.known_for_org_id join m on m.source = o.source and m.source_id = o.source_id""")
def j13_remap_ids(spark, d):
    orgs = table(spark, d, "organizations").select("id", "source", "source_id")
    first = orgs.groupBy("source", "source_id").agg(F.min("id").alias("new_id"))
    people = table(spark, d, "people").where("known_for_org_id is not null").select(c("id").alias("person_id"), c("known_for_org_id").alias("id"))
    return people.join(orgs.join(first, ["source", "source_id"]).select("id", "new_id"), "id").select(c("person_id").alias("id"), "new_id")


@query("""with names as (select distinct x from (select region as x from organizations union all select country from people) where x <> ''),
  labels as (select name, arg_min(qid, id) as qid from locations where qid is not null group by 1) select x as place, qid from names left join labels on labels.name = x""")
def j14_rebuild_locations(spark, d):
    names = table(spark, d, "organizations").select(c("region").alias("place")).union(table(spark, d, "people").select("country")).where("place <> ''").distinct()
    labels = table(spark, d, "locations").where("qid is not null").groupBy(c("name").alias("place")).agg(F.min_by("qid", "id").alias("qid"))
    return names.join(labels, "place", "left")


_SPAN = "id, name_normalized, from_date, coalesce(nullif(to_date, ''), '9999-12-31') as until"


@query(f"""with p as (select {_SPAN} from people where name_normalized <> '' and from_date <> '')
  select a.id as id_a, b.id as id_b from p a join p b on a.name_normalized = b.name_normalized and a.id < b.id and a.from_date <= b.until and b.from_date <= a.until""")
def j15_date_overlap(spark, d):
    """Pairs of people rows of one name whose terms overlap; an open end lies beyond every date."""
    people = table(spark, d, "people").where("name_normalized <> '' and from_date <> ''").select("id", "name_normalized", "from_date", F.coalesce(F.nullif("to_date", F.lit("")), F.lit("9999-12-31")).alias("until"))
    a, b = people.alias("a"), people.alias("b")
    overlap = (c("a.id") < c("b.id")) & (c("a.from_date") <= c("b.until")) & (c("b.from_date") <= c("a.until"))
    return a.join(b, (c("a.name_normalized") == c("b.name_normalized")) & overlap).select(c("a.id").alias("id_a"), c("b.id").alias("id_b"))


@query(f"""with {SQL_TRIPLES}, s as (select seq, source_text, object from triples) select t.seq, min(s.seq) as sentence from triples t join s on s.object = t.object and contains(s.source_text, t.subject) group by 1""")
def j16_source_sentence(spark, d):
    """The first sentence about the same object that names the subject."""
    return first_sentences(triples(spark, d))


# Pieces of a text that stand for a subject: a blank with the character before and six or one after it, or as many characters as the number says.
_PIECES = {"blank 6": r"(?s)(?=(. .{6}))", "blank 1": r"(?s)(?=(. .))", "3": r"(?s)(?=(.{3}))", "2": r"(?s)(?=(.{2}))", "1": r"(?s)(?=(.))"}


def first_sentences(rows):
    """``(seq, sentence)``: of the rows with the same object whose ``source_text`` contains the subject of row ``seq``, the smallest ``seq``.

    One object may have any number of subjects and sentences, so they meet by the object with a piece of text: a subject by the last
    piece of the first kind that it has, a sentence by each of its pieces. Pieces of other kinds than the first, of which a text has many, are
    taken only where a subject of the object needs them. Equal subjects of an object are looked up once, by the smallest ``seq``. What meets is compared exactly.
    """
    pieces = lambda text, kind: F.regexp_extract_all(text, F.lit(_PIECES[kind]), F.lit(1))
    key = [F.xxhash64("object", "kind", "piece").alias("key"), F.hash("object").alias("about")]  # 96 bits stand for the object and the piece
    first, *others = _PIECES
    named = rows.where("subject is not null and object is not null").select("seq", "object", "subject").withColumn("own", F.min("seq").over(Window.partitionBy("object", "subject")))
    own = [F.struct(F.lit(k).alias("kind"), F.element_at(pieces(c("subject"), k), F.lit(-1)).alias("piece")) for k in _PIECES]
    kept = F.coalesce(*[F.when(c("subject").rlike(_PIECES[k]), s) for k, s in zip(_PIECES, own, strict=True)], F.struct(F.lit("").alias("kind"), F.lit("").alias("piece")))
    subjects = named.where("seq = own").select("own", "object", "subject", kept.alias("p")).select("own", "object", "subject", c("p.kind").alias("kind"), c("p.piece").alias("piece"))

    texts = rows.where("source_text is not null and object is not null").select(c("seq").alias("sentence"), "object", "source_text")
    wanted = subjects.where(c("kind") != first).select("object", "kind").distinct()
    every = F.when(c("kind") == "", F.array(F.lit("")))
    for kind in others:
        every = every.when(c("kind") == kind, pieces(c("source_text"), kind))
    far = texts.select("object", "sentence", F.lit(first).alias("kind"), F.explode(F.array_distinct(pieces(c("source_text"), first))).alias("piece"))
    near = texts.join(wanted, "object").select("object", "sentence", "kind", F.explode(F.array_distinct(every)).alias("piece"))
    met = far.unionByName(near).select(*key, "sentence").join(subjects.select(*key, "own", "subject"), ["key", "about"]).select("own", "subject", "sentence")
    found = met.join(texts.select("sentence", "source_text"), "sentence").where(F.contains("source_text", c("subject"))).groupBy("own").agg(F.min("sentence").alias("sentence"))
    return named.select("seq", "own").join(found, "own").select("seq", "sentence")


@query(f"""with {SQL_TRIPLES} select t.seq, coalesce(o.name, t.object) as object_name, coalesce(o.source, 'none') as object_source from triples t left join organizations o on o.id = t.org_id""")
def j17_canonical_entities(spark, d):
    orgs = table(spark, d, "organizations").select(c("id").alias("org_id"), "name", c("source").alias("org_source"))
    joined = triples(spark, d).join(orgs, "org_id", "left")
    return joined.select("seq", F.coalesce("name", "object").alias("object_name"), F.coalesce("org_source", F.lit("none")).alias("object_source"))


@query("""with t as (select distinct text from documents), k as (select text, (length(text) % 11)::int as topic from t) select d.doc_id, k.topic from documents d join k on k.text = d.text""")
def j18_classify_unique_texts(spark, d):
    """Each distinct text is classified once and the result joined back, by hash and text."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    once = docs.dropDuplicates(["h", "text"]).select("h", "text", (F.length("text") % 11).alias("topic"))
    return docs.join(once, ["h", "text"]).select("doc_id", "topic")


@query(r"""with t as (select id, record['ticker'] as ticker, lower(name) as n, regexp_replace(lower(name), ' (inc|corp|corporation|ltd|limited|plc|llc)\.?\z', '', 'g') as s from organizations where record['ticker'] is not null),
  q as (select distinct known_for_org as text, lower(known_for_org) as n, regexp_replace(lower(known_for_org), ' (inc|corp|corporation|ltd|limited|plc|llc)\.?\z', '', 'g') as s from people where known_for_org <> ''),
  h as (select q.text, t.ticker, case when q.n = t.n then 1 else 2 end as tier, t.id as tid from q join t on q.n = t.n or q.s = t.s)
  select text, arg_min(ticker, (tier, tid)) as ticker from h group by 1""")
def j20_ticker_lookup(spark, d):
    """Employers take the ticker of an organization of equal name, else of one equal without its legal form."""
    short = lambda x: F.regexp_replace(x, r" (inc|corp|corporation|ltd|limited|plc|llc)\.?\z", "")
    named = lambda df, x: df.withColumns({"n": F.lower(x), "s": short(F.lower(x))})
    listed = named(table(spark, d, "organizations").select(c("id").alias("tid"), "name", F.element_at("record", F.lit("ticker")).alias("ticker")).where("ticker is not null"), "name")
    asked = named(table(spark, d, "people").select(c("known_for_org").alias("text")).where("text <> ''").distinct(), "text")
    exact = asked.join(listed.select("n", "tid", "ticker"), "n").select("text", "ticker", F.lit(1).alias("tier"), "tid")
    bare = asked.join(listed.select("s", "tid", "ticker"), "s").select("text", "ticker", F.lit(2).alias("tier"), "tid")
    return exact.unionByName(bare).groupBy("text").agg(F.min_by("ticker", F.struct("tier", "tid")).alias("ticker"))


@query("""select p.id, o.id as org_id from people p join organizations o on o.id = p.known_for_org_id where contains(lower(o.name), lower(p.known_for_org)) or contains(lower(p.known_for_org), lower(o.name))""")
def j21_contained_entities(spark, d):
    orgs = table(spark, d, "organizations").select(c("id").alias("org_id"), F.lower("name").alias("a"))
    people = table(spark, d, "people").select("id", c("known_for_org_id").alias("org_id"), F.lower("known_for_org").alias("b"))
    return people.join(orgs, "org_id").where(F.contains("a", c("b")) | F.contains("b", c("a"))).select("id", "org_id")


# --- aggregations -----------------------------------------------------------------------------------------------


@query("select source, count(*) as n from organizations group by grouping sets ((), (source))")
def a01_org_counts(spark, d):
    return table(spark, d, "organizations").groupingSets([[], [c("source")]], c("source")).agg(F.count(F.lit(1)).alias("n"))


@query("select person_type, source, count(*) as n from people group by grouping sets ((), (person_type), (source))")
def a02_people_counts(spark, d):
    return table(spark, d, "people").groupingSets([[], [c("person_type")], [c("source")]], c("person_type"), c("source")).agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select canon_id, count(*) as n from role_records where canon_id is not null group by 1)
  select (select count(*) from role_records) as total, coalesce(sum(n), 0)::bigint as canonicalized, count(*) as groups, count(*) filter (n > 1) as multi_groups, coalesce(sum(n) filter (n > 1), 0)::bigint as in_multi from g""")
def a03_canon_stats(spark, d):
    roles = table(spark, d, "role_records")
    g = roles.where("canon_id is not null").groupBy("canon_id").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    stats = g.agg(zero(F.sum("n")).alias("canonicalized"), F.count(F.lit(1)).alias("groups"), F.count_if(c("n") > 1).alias("multi_groups"), zero(F.sum(F.when(c("n") > 1, c("n")))).alias("in_multi"))
    return roles.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(stats))


@query("select lower(trim(simplified_type)) as kind, count(*) as n, count(qid) as with_qid from locations group by 1")
def a04_location_stats(spark, d):
    return table(spark, d, "locations").groupBy(F.lower(F.trim("simplified_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("qid").alias("with_qid"))


@query("select distinct source, source_id from organizations")
def a05_distinct_source_ids(spark, d):
    return table(spark, d, "organizations").select("source", "source_id").distinct()


@query("select count(*) as orgs, count(e.vec_id) as with_embedding, count(*) - count(e.vec_id) as without_embedding from organizations o left join embeddings e on e.vec_id = o.id")
def a06_embedding_counts(spark, d):
    joined = table(spark, d, "organizations").select(c("id").alias("vec_id")).join(table(spark, d, "embeddings").select("vec_id", F.lit(1).alias("has")), "vec_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("orgs"), F.count("has").alias("with_embedding"), (F.count(F.lit(1)) - F.count("has")).alias("without_embedding"))


@query("""select 'organizations' as kind, source, count(*) as n from organizations group by 2 union all select 'people', source, count(*) from people group by 2
  union all select 'locations', simplified_type, count(*) from locations group by 2""")
def a07_status_report(spark, d):
    part = lambda t, by: table(spark, d, t).groupBy(c(by).alias("source")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("kind"), "source", "n")
    return part("organizations", "source").unionByName(part("people", "source")).unionByName(part("locations", "simplified_type")).orderBy(F.desc("n"), "kind", "source")


@query(f"""with {SQL_TRIPLES}, g as (select source, lower(subject) as s, lower(predicate) as p, lower(object) as o, count(*) as k from triples group by all),
  t as (select source, sum(k) as n, sum(k * (k - 1) / 2) as dup from g group by 1) select source, round(case when n > 1 then dup / (n * (n - 1) / 2) else 0 end, 9) as redundancy from t""")
def a08_redundancy(spark, d):
    """Share of duplicate pairs among all pairs, from counts, in linear time."""
    g = triples(spark, d).groupBy("source", F.lower("subject"), F.lower("predicate"), F.lower("object")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    t = g.groupBy("source").agg(F.sum("k").alias("n"), F.sum(c("k") * (c("k") - 1) / 2).alias("dup"))
    return t.select("source", F.round(F.when(c("n") > 1, c("dup") / (c("n") * (c("n") - 1) / 2)).otherwise(0.0), 9).alias("redundancy"))


_SPANS = "select doc_id, s.lo, least(s.lo + 40 + (doc_id % 7) * 15, length(text)) as hi from documents, (select unnest([0, 25, 90, 300]) as lo) as s where length(text) > 0 and s.lo < length(text)"


@query(f"""with spans as ({_SPANS}), m as (select *, max(hi) over (partition by doc_id order by lo, hi rows between unbounded preceding and 1 preceding) as seen from spans),
  k as (select doc_id, sum(greatest(0, hi - greatest(lo, coalesce(seen, 0)))) as covered from m group by 1)
  select k.doc_id, round(covered / length(text), 9) as coverage from k join documents d using (doc_id)""")
def a09_coverage(spark, d):
    """Share of a text that the union of its spans covers: intervals are merged by a running maximum."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    spans = docs.select("doc_id", "n", F.explode(F.array(*map(F.lit, (0, 25, 90, 300)))).alias("lo")).where("lo < n")
    spans = spans.withColumn("hi", F.least(c("lo") + 40 + (c("doc_id") % 7) * 15, c("n")))
    seen = F.max("hi").over(Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), c("hi") - F.greatest(c("lo"), F.coalesce("seen", F.lit(0))))
    return spans.withColumn("seen", seen).groupBy("doc_id", "n").agg(F.sum(gain).alias("covered")).select("doc_id", F.round(c("covered") / c("n"), 9).alias("coverage"))


@query(f"""with {SQL_TRIPLES}, b as (select source, seq % 5 as beam, count(*) as n, sum(confidence) as q, count(distinct lower(subject)) as s from triples group by 1, 2)
  select source, beam, round(q + 0.5 * s / n - 0.3 * (1 - s / n) - 0.1 * n / 10, 6) as score from b""")
def a10_beam_score(spark, d):
    b = triples(spark, d).groupBy("source", (c("seq") % 5).alias("beam")).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("q"), F.count_distinct(F.lower("subject")).alias("s"))
    return b.select("source", "beam", F.round(c("q") + 0.5 * c("s") / c("n") - 0.3 * (1 - c("s") / c("n")) - 0.1 * c("n") / 10, 6).alias("score"))


@query(f"""with {SQL_TRIPLES} select seq, round(0.4 * confidence + 0.2 * 0.95 + 0.2 * 0.9 + 0.2 * (case when org_id is null then 0.5 else 0.98 end), 6) as confidence from triples""")
def a12_weighted_confidence(spark, d):
    canon = F.when(c("org_id").isNull(), 0.5).otherwise(0.98)
    return triples(spark, d).select("seq", F.round(0.4 * c("confidence") + F.lit(0.2) * 0.95 + F.lit(0.2) * 0.9 + 0.2 * canon, 6).alias("confidence"))


@query("select source, count(*) as documents, coalesce(sum(n_chars), 0)::bigint as chars, count(*) filter (text is null or trim(text) = '') as blank, count(distinct text) as distinct_texts from documents group by 1")
def a13_document_counters(spark, d):
    docs = table(spark, d, "documents").groupBy("source")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.count_if(c("text").isNull() | (F.trim("text") == "")).alias("blank"), F.count_distinct("text").alias("distinct_texts"))


@query(f"""with {SQL_TRIPLES}, g as (select source, predicate, count(*) as n from triples group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, predicate) as k from g) select source, predicate, n from r where k <= 5""")
def a14_top_predicates(spark, d):
    g = triples(spark, d).groupBy("source", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "predicate"))).where("k <= 5").drop("k")


@query("""select o.id, case when max(s) >= 0.9 then 1.0 when max(s) >= 0.7 then 0.8 when max(s) >= 0.5 then 0.6 when max(s) >= 0.3 then 0.4 else 0.2 end as entity_score
  from (select o.id, case when lower(p.known_for_org) = lower(o.name) then 1.0 when contains(lower(o.name), lower(p.known_for_org)) then 0.8 else 0.3 end * ((p.id % 10) / 10.0) as s from organizations o join people p on p.known_for_org_id = o.id) as o group by 1""")
def a15_entity_score(spark, d):
    """The best mention of an organization, exact ones whole, partial ones for four fifths, in five tiers."""
    orgs = table(spark, d, "organizations").select("id", F.lower("name").alias("name"))
    people = table(spark, d, "people").select(c("known_for_org_id").alias("id"), F.lower("known_for_org").alias("text"), ((c("id") % 10) / 10.0).alias("w"))
    kind = F.when(c("text") == c("name"), 1.0).when(F.contains("name", c("text")), 0.8).otherwise(0.3)
    best = people.join(orgs, "id").groupBy("id").agg(F.max(F.round(kind * c("w"), 9)).alias("s"))
    return best.select("id", F.when(c("s") >= 0.9, 1.0).when(c("s") >= 0.7, 0.8).when(c("s") >= 0.5, 0.6).when(c("s") >= 0.3, 0.4).otherwise(0.2).alias("entity_score"))


@query(f"with {SQL_TRIPLES} select entity, count(*) as mentions from (select subject as entity from triples union all select object from triples) group by 1")
def a16_distinct_entities(spark, d):
    return triples(spark, d).select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))


# --- windows ----------------------------------------------------------------------------------------------------


@query(f"with {SQL_TRIPLES} select min(seq) as seq from triples group by lower(trim(subject)), lower(trim(predicate)), lower(trim(object))")
def w01_keep_first(spark, d):
    low = lambda x: F.lower(F.trim(x))
    return triples(spark, d).groupBy(low("subject"), low("predicate"), low("object")).agg(F.min("seq").alias("seq")).select("seq")


@query(f"with {SQL_TRIPLES} select arg_max(seq, (confidence, -seq)) as seq from triples group by lower(subject), lower(predicate), lower(object)")
def w02_keep_best(spark, d):
    best = F.max_by("seq", F.struct("confidence", (-c("seq")).alias("o")))
    return triples(spark, d).groupBy(F.lower("subject"), F.lower("predicate"), F.lower("object")).agg(best.alias("seq")).select("seq")


@query(f"with {SQL_TRIPLES} select arg_max(seq, (confidence, -seq)) as seq from triples where source_text is not null group by source_text union all select seq from triples where source_text is null")
def w03_best_per_source(spark, d):
    rows = triples(spark, d)
    best = rows.where("source_text is not null").groupBy("source_text").agg(F.max_by("seq", F.struct("confidence", (-c("seq")).alias("o"))).alias("seq")).select("seq")
    return best.union(rows.where("source_text is null").select("seq"))


@query(f"""with {SQL_TRIPLES}, e as (select seq, lower(subject) as s, lower(predicate) as p, lower(object) as o from triples union all select seq + 10000000000, lower(object), lower(predicate), lower(subject) from triples where seq % 3 = 0)
  select min(seq) as seq, count(*) as merged from e group by least(s, o), p, greatest(s, o)""")
def w04_reversal_dedup(spark, d):
    """Statements and their reversals are one; the first orientation stays."""
    rows = triples(spark, d).select("seq", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"))
    turned = rows.where("seq % 3 = 0").select((c("seq") + 10000000000).alias("seq"), c("o").alias("s"), "p", c("s").alias("o"))
    both = rows.unionByName(turned)
    return both.groupBy(F.least("s", "o"), "p", F.greatest("s", "o")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("merged")).select("seq", "merged")


@query(f"""with r as (select id, name_normalized, {_sql_priority('source', schema.ORG_PRIORITY)} as p from organizations where name_normalized <> ''),
  m as (select name_normalized, arg_min(id, (p, id)) as canon_id, count(*) as n from r group by 1) select r.id, m.canon_id, case when r.id = m.canon_id then n else 1 end as canon_size from r join m using (name_normalized)""")
def w06_canonical_pick(spark, d):
    rows = table(spark, d, "organizations").where("name_normalized <> ''").select("id", "name_normalized", _priority(c("source"), schema.ORG_PRIORITY).alias("p"))
    best = rows.groupBy("name_normalized").agg(F.min_by("id", F.struct("p", "id")).alias("canon_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(best, "name_normalized").select("id", "canon_id", F.when(c("id") == c("canon_id"), c("n")).otherwise(F.lit(1)).alias("canon_size"))


@query("select id, name from organizations where id > 1000 order by id limit 100")
def w07_keyset_page(spark, d):
    return table(spark, d, "organizations").where("id > 1000").orderBy("id").limit(100).select("id", "name")  # the feature: one page


@query("select name as label, arg_min(qid, id) as qid from locations where qid is not null group by 1")
def w08_label_first_qid(spark, d):
    return table(spark, d, "locations").where("qid is not null").groupBy(c("name").alias("label")).agg(F.min_by("qid", "id").alias("qid"))


_PAGES = "select doc_id, unnest(string_split(text, chr(12))) as page, generate_subscripts(string_split(text, chr(12)), 1) as page_number from documents where text is not null"


@query(f"""with pages as ({_PAGES}) select doc_id, page_number, coalesce(sum(length(page) + 1) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0)::bigint as char_offset from pages""")
def w09_page_offsets(spark, d):
    """Offset of each page (texts are divided at page breaks) in the text joined by single characters, from array lengths."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\f").alias("pages"))
    pages = docs.select("doc_id", F.posexplode(F.transform("pages", lambda p, i: F.aggregate(F.slice(c("pages"), F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1))).alias("i", "char_offset"))
    return pages.select("doc_id", (c("i") + 1).cast("bigint").alias("page_number"), "char_offset")


@query(f"""with pages as ({_PAGES}), o as (select doc_id, page_number, coalesce(sum(length(page) + 1) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0) as lo, length(page) as n from pages)
  select doc_id, page_number from o where lo < 1500 and lo + n > 1000""")
def f10_pages_of_range(spark, d):
    """Pages that overlap the characters 1000 to 1500."""
    pages = w09_page_offsets(spark, d)
    sizes = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.transform(F.split("text", "\f"), F.length)).alias("i", "n")).select("doc_id", (c("i") + 1).cast("bigint").alias("page_number"), "n")
    return pages.join(sizes, ["doc_id", "page_number"]).where("char_offset < 1500 and char_offset + n > 1000").select("doc_id", "page_number")


# --- sorts and top k --------------------------------------------------------------------------------------------


@query("""select id, name, case when lower(name) = 'director' then 1.0 when starts_with(lower(name), 'director') then 0.9 else 0.7 end as score from role_records where contains(lower(name), 'director') order by score desc, length(name), id limit 25""")
def t03_role_search(spark, d):
    low = F.lower("name")
    hits = table(spark, d, "role_records").where(F.contains(low, F.lit("director"))).select("id", "name", F.when(low == "director", 1.0).when(F.startswith(low, F.lit("director")), 0.9).otherwise(0.7).alias("score"))
    return hits.orderBy(F.desc("score"), F.length("name"), "id").limit(25)  # the feature: a list of the best


@query("""select id, name, lower(trim(simplified_type)) as kind from locations where lower(trim(simplified_type)) in ('city', 'district') and contains(lower(name), 'nor') order by length(name), id limit 25""")
def t04_location_search(spark, d):
    kind = F.lower(F.trim("simplified_type"))
    return table(spark, d, "locations").where(kind.isin("city", "district") & F.contains(F.lower("name"), F.lit("nor"))).orderBy(F.length("name"), "id").limit(25).select("id", "name", kind.alias("kind"))


@query(f"with {SQL_TRIPLES} select seq, round(confidence, 6) as confidence from triples order by confidence desc, seq limit 100")
def t06_ranked_statements(spark, d):
    return triples(spark, d).orderBy(F.desc("confidence"), "seq").limit(100).select("seq", F.round("confidence", 6).alias("confidence"))


@query(f"""with {SQL_TRIPLES}, b as (select source, seq % 5 as beam, round(sum(confidence), 6) as q from triples group by 1, 2), r as (select *, row_number() over (partition by source order by q desc, beam) as k from b) select source, beam, k from r where k <= 3""")
def t07_best_beams(spark, d):
    b = triples(spark, d).groupBy("source", (c("seq") % 5).alias("beam")).agg(F.round(F.sum("confidence"), 6).alias("q"))
    return b.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("q"), "beam"))).where("k <= 3").select("source", "beam", "k")


@query("with r as (select source, id, row_number() over (partition by source order by id) as k from organizations) select source, id from r where k <= 50")
def t09_quota_per_category(spark, d):
    ranked = table(spark, d, "organizations").select("source", "id", F.row_number().over(Window.partitionBy("source").orderBy("id")).alias("k"))
    return ranked.where("k <= 50").select("source", "id")


# --- set operations ---------------------------------------------------------------------------------------------


@query("select x as place from (select region as x from organizations union select country from people) where x <> ''")
def u01_places(spark, d):
    return table(spark, d, "organizations").select(c("region").alias("place")).union(table(spark, d, "people").select("country")).where("place <> ''").distinct()


@query("""select x as qid from (select source_id as x from organizations where regexp_matches(source_id, '^Q[0-9]') union select source_id from people where regexp_matches(source_id, '^Q[0-9]')) where x not in (select 'Q' || qid from locations where qid is not null)""")
def u02_unresolved_qids(spark, d):
    shaped = lambda t: table(spark, d, t).where(c("source_id").rlike("^Q[0-9]")).select(c("source_id").alias("qid"))
    known = table(spark, d, "locations").where("qid is not null").select(N.format_qid(c("qid")).alias("qid"))
    return shaped("organizations").union(shaped("people")).distinct().join(known, "qid", "left_anti")


@query("select distinct name_normalized as label from role_records where name_normalized not in (select lower(title) from ref_roles)")
def u03_new_labels(spark, d):
    known = table(spark, d, "ref_roles").select(F.lower("title").alias("label"))
    return table(spark, d, "role_records").select(c("name_normalized").alias("label")).where("label is not null").distinct().join(known, "label", "left_anti")


@query("select p.id from people p where not exists (select 1 from organizations o where o.name = p.known_for_org) and p.known_for_org <> ''")
def u04_skip_existing(spark, d):
    known = table(spark, d, "organizations").where("name is not null").select(c("name").alias("known_for_org"))
    return table(spark, d, "people").where("known_for_org <> ''").join(known, "known_for_org", "left_anti").select("id")


@query(f"with {SQL_TRIPLES} select source || ':' || (seq % 5) as pool, count(*) as n from triples group by 1 union all select 'all', count(*) from triples")
def u05_pooled(spark, d):
    rows = triples(spark, d)
    return rows.groupBy(F.concat_ws(":", "source", (c("seq") % 5).cast("string")).alias("pool")).agg(F.count(F.lit(1)).alias("n")).union(rows.agg(F.count(F.lit(1))).select(F.lit("all"), "*"))


# --- canonicalization -------------------------------------------------------------------------------------------

_LEI = "case when source = 'gleif' then upper(source_id) else upper(record['lei']) end"
_CANON_EDGES = f"""k as (
    select id, 'lei|' || {_LEI} as k from organizations where {_LEI} <> '' union all
    select id, 'ticker|' || upper(record['ticker']) from organizations where record['ticker'] <> '' union all
    select id, 'cik|' || source_id from organizations where source = 'sec_edgar' and source_id <> '' union all
    select id, 'name|' || {N.sql_canon_name('name')} || '|' || iso from regioned where {N.sql_canon_name('name')} <> '' union all
    select id, 'full|' || {N.sql_expand_suffix(N.sql_canon_name('name'))} || '|' || iso from regioned where {N.sql_canon_name('name')} <> ''),
  h as (select k, min(id) as head from k group by 1), e as (select distinct head as a, id as b from k join h using (k) where head <> id)"""
_CLOSE = """two as (select a, b from e union select b, a from e), reach as (select a as id, a as seen from two union select r.id, t.b from reach r join two t on t.a = r.seen), comp as (select id, min(seen) as component from reach group by 1)"""


@query(f"""with recursive {sql_lookup()}, regioned as (select o.*, coalesce(iso, '') as iso from organizations o left join lookup on lower(trim(region)) = spelling), {_CANON_EDGES}, {_CLOSE},
  r as (select o.id, coalesce(component, o.id) as component, {_sql_priority('source', schema.ORG_PRIORITY)} as p from organizations o left join comp using (id)), best as (select component, arg_min(id, (p, id)) as canon_id, count(*) as n from r group by 1)
  select r.id, canon_id, case when r.id = canon_id then n else 1 end as canon_size from r join best using (component)""")
def g02_canonicalize_orgs(spark, d):
    """Organizations of one LEI, ticker, CIK or name in one region are one; the most trusted row represents them."""
    orgs = with_region(table(spark, d, "organizations").select("id", "name", "source", "source_id", "region", "record"), "region", region_lookup(spark, table(spark, d, "ref_countries")))
    filled = lambda x: F.nullif(x, F.lit(""))
    lei = filled(F.upper(F.when(c("source") == "gleif", c("source_id")).otherwise(F.element_at("record", F.lit("lei")))))
    name = filled(N.canon_name(c("name")))
    keys = [lei, filled(F.upper(F.element_at("record", F.lit("ticker")))), F.when(c("source") == "sec_edgar", filled(c("source_id"))), F.concat_ws("|", name, "iso"), F.concat_ws("|", N.expand_suffix(name), "iso")]
    keys[3:] = [F.when(name.isNotNull(), k) for k in keys[3:]]
    found = connected_components(star_edges(orgs, keys))
    return pick_canonical(orgs.select("id", "source"), found, _priority(c("source"), schema.ORG_PRIORITY)).select("id", "canon_id", c("canon_size").cast("bigint").alias("canon_size"))


@query(f"""with recursive p as (select id, name_normalized, source, from_date, coalesce(nullif(to_date, ''), '9999-12-31') as until, case when known_for_org_id is not null then '#' || known_for_org_id else nullif(lower(trim(known_for_org)), '') end as org from people where name_normalized <> ''),
  h as (select name_normalized, org, min(id) as head from p where org is not null group by 1, 2),
  e as (select distinct head as a, id as b from p join h using (name_normalized, org) where head <> id union select a.id, b.id from p a join p b on a.name_normalized = b.name_normalized and a.id < b.id and a.from_date <> '' and b.from_date <> '' and a.from_date <= b.until and b.from_date <= a.until),
  {_CLOSE}, r as (select o.id, coalesce(component, o.id) as component, {_sql_priority('source', schema.PERSON_PRIORITY)} as pr from people o left join comp using (id)), best as (select component, arg_min(id, (pr, id)) as canon_id, count(*) as n from r group by 1)
  select r.id, canon_id, case when r.id = canon_id then n else 1 end as canon_size from r join best using (component)""")
def g03_canonicalize_people(spark, d):
    """People of one name are one if they share an employer or their terms overlap.

    Overlaps are linked by a sweep: within a name, sorted by start, a term that begins before the latest end so far
    overlaps the terms before it, so one link to the previous row joins the same people as all overlapping pairs do.
    """
    people = table(spark, d, "people").where("name_normalized <> ''")
    org = F.when(c("known_for_org_id").isNotNull(), F.concat(F.lit("#"), c("known_for_org_id"))).otherwise(F.nullif(F.lower(F.trim("known_for_org")), F.lit("")))
    by_org = star_edges(people, [F.when(org.isNotNull(), F.concat_ws("|", "name_normalized", org))])
    terms = people.where("from_date <> ''").select("id", "name_normalized", "from_date", F.coalesce(F.nullif("to_date", F.lit("")), F.lit("9999-12-31")).alias("until")).where("from_date <= until")
    # a range sort, so that the rows of a frequent name lie in many partitions; what came before in the same name is carried in
    ordered = cut(terms.repartitionByRange("name_normalized", "from_date", "id").withColumn("p", F.spark_partition_id()))
    ends = ordered.groupBy("name_normalized", "p").agg(F.max("until").alias("most"), F.max_by("id", F.struct("from_date", "id")).alias("last"))
    ahead = Window.partitionBy("name_normalized").orderBy("p")  # one row a partition
    carried = ends.select("name_normalized", "p", F.max("most").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("reach0"), F.lag("last").over(ahead).alias("before0")).where("reach0 is not null")
    w = Window.partitionBy("p", "name_normalized").orderBy("from_date", "id")
    swept = ordered.withColumn("reach", F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.lag("id").over(w)).join(carried, ["name_normalized", "p"], "left")
    swept = swept.withColumns({"reach": F.greatest("reach", "reach0"), "before": F.coalesce("before", "before0")})
    by_date = swept.where("before is not null and from_date <= reach").select(c("before").alias("a"), c("id").alias("b"))
    # a term that ends before it starts overlaps only terms around both of its days
    odd = people.where("from_date <> '' and to_date <> '' and to_date < from_date").select(c("id").alias("b"), "name_normalized", c("from_date").alias("f"), c("to_date").alias("t"))
    all_terms = people.where("from_date <> ''").select(c("id").alias("a"), "name_normalized", "from_date", F.coalesce(F.nullif("to_date", F.lit("")), F.lit("9999-12-31")).alias("until"))
    by_odd = odd.join(all_terms, "name_normalized").where("a <> b and from_date <= t and f <= until").select("a", "b")
    found = connected_components(by_org.unionByName(by_date).unionByName(by_odd))
    rows = table(spark, d, "people").select("id", "source")
    return pick_canonical(rows, found, _priority(c("source"), schema.PERSON_PRIORITY)).select("id", "canon_id", c("canon_size").cast("bigint").alias("canon_size"))


@query("""with recursive e as (select distinct left_id as a, right_id as b from role_matches where is_match and left_id <> right_id and left_id is not null and right_id is not null),
  two as (select a, b from e union select b, a from e), reach as (select a as id, a as seen from two union select r.id, t.b from reach r join two t on t.a = r.seen) select id as node, min(seen) as component from reach group by 1""")
def g01_components(spark, d):
    return connected_components(table(spark, d, "role_matches").where("is_match"), "left_id", "right_id")


# --- writes -----------------------------------------------------------------------------------------------------


@query("""select id, name, source, source_id from organizations qualify row_number() over (partition by source, source_id order by id desc) = 1""")
def k01_upsert_orgs(spark, d):
    """Rows loaded in order of id, the later replaces the earlier of the same source record."""
    orgs = table(spark, d, "organizations").select("id", "name", "source", "source_id")
    half = orgs.agg(F.expr("percentile_approx(id, 0.5)")).first()[0] or 0
    old = store.last_of_each(orgs.where(c("id") <= half), ["source", "source_id"], [c("id")])
    return store.upsert(old, orgs.where(c("id") > half), ["source", "source_id"], [c("id")])


@query("""select id, name from people qualify row_number() over (partition by source, source_id, known_for_role, known_for_org order by id desc) = 1""")
def k02_upsert_people(spark, d):
    people = table(spark, d, "people").select("id", "name", "source", "source_id", "known_for_role", "known_for_org")
    keys = ["source", "source_id", "known_for_role", "known_for_org"]
    old, new = people.where("id % 2 = 0"), people.where("id % 2 = 1")
    # both halves are loaded one after the other; which id is later decides, as in one load
    return store.last_of_each(store.last_of_each(old, keys, [c("id")]).unionByName(new), keys, [c("id")]).select("id", "name")


@query("select id, name_normalized, source_id from role_records qualify row_number() over (partition by name_normalized, source_id order by id) = 1")
def k03_insert_or_ignore(spark, d):
    roles = table(spark, d, "role_records").select("id", "name_normalized", "source_id")
    return store.insert_ignore(roles.limit(0), roles, ["name_normalized", "source_id"], [c("id")])


@query("""with new as (select distinct known_for_role as title from people where known_for_role is not null and known_for_role not in (select title from ref_roles))
  select row_number() over (order by title) as role_id, title from ref_roles union all select (select count(*) from ref_roles) + row_number() over (order by encode(title)), title from new""")
def k04_get_or_create(spark, d):
    listed = table(spark, d, "ref_roles").select("title")
    dim = listed.withColumn("role_id", F.row_number().over(Window.orderBy("title")).cast("bigint"))  # 38 rows
    return store.get_or_create(dim, table(spark, d, "people").select(c("known_for_role").alias("title")), "title", "role_id")


@query("select source, count(*) as n from organizations where source <> 'wikipedia' group by 1")
def k05_delete_source(spark, d):
    return table(spark, d, "organizations").where("source <> 'wikipedia'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""with u as (select known_for_org_id as id, min(nullif(from_date, '')) as from_date from people where known_for_org_id is not null group by 1)
  select o.id, coalesce(u.from_date, o.from_date, '') as from_date from organizations o left join u using (id)""")
def k06_coalesce_update(spark, d):
    updates = table(spark, d, "people").where("known_for_org_id is not null").groupBy(c("known_for_org_id").alias("id")).agg(F.min(F.nullif("from_date", F.lit(""))).alias("from_date"))
    return store.coalesce_update(table(spark, d, "organizations").select("id", "from_date"), updates, "id", ["from_date"])


@query("select id, name, '{}' as record from organizations")
def k07_lite(spark, d):
    return table(spark, d, "organizations").select("id", "name", F.lit("{}").alias("record"))


_ENTRIES = "select sha256(coalesce(name, '') || ':canonical=true') as cache_key, coalesce(region, '') as result, loaded_at as created_at, length(coalesce(name, '')) as size from organizations"


@query(f"with e as ({_ENTRIES}) select cache_key, result from e where result <> '' and created_at >= timestamp '2022-01-01' - interval 24 hours qualify row_number() over (partition by cache_key order by created_at desc, result desc) = 1")
def k16_cache_live(spark, d):
    orgs = table(spark, d, "organizations")
    entries = orgs.select(F.sha2(F.concat(F.coalesce("name", F.lit("")), F.lit(":canonical=true")), 256).alias("cache_key"), F.coalesce("region", F.lit("")).alias("result"), c("loaded_at").alias("created_at"))
    return store.cache_live(entries, F.expr("timestamp_ntz '2022-01-01 00:00:00'")).select("cache_key", "result")


@query("""with r as (select id::varchar as cache_key, sum(length(name)) over (order by loaded_at desc, id::varchar) as running from organizations where name is not null) select cache_key, running::bigint as running from r where running <= 20000""")
def k16_cache_within(spark, d):
    entries = table(spark, d, "organizations").where("name is not null").select(c("id").cast("string").alias("cache_key"), F.length("name").alias("size"), c("loaded_at").alias("used_at"))
    return store.cache_within(entries, 20000).select("cache_key", c("running").cast("bigint").alias("running"))
