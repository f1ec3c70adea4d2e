"""Queries over search and qualification. Records take the vectors of the table in turn: id modulo the number of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import knn, search
from ..tables import table

c = F.col
QUERIES, ORACLES = {}, {}


def query(sql=None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.select("id", F.pmod("id", F.lit(max(1, e.count()))).alias("vec_id")).join(e, "vec_id").select("id", "embedding")


def _organizations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Organizations with rows of one LEI as their canonical groups, their vectors, and the query set: every fiftieth by its own name and vector."""
    orgs = table(spark, d, "organizations").select("id", "name", "name_normalized", "source", "record")
    lei = F.upper(F.element_at("record", F.lit("lei")))
    groups = orgs.where(lei.isNotNull()).groupBy(lei.alias("lei")).agg(F.min("id").alias("canon_id"))
    orgs = orgs.withColumn("lei", lei).join(groups, "lei", "left").drop("lei")
    vectors = _vectors(spark, d, orgs)
    asked = orgs.where("id % 50 = 0").join(vectors, "id").select(c("id").alias("query_id"), c("name").alias("query_text"), "embedding")
    return orgs, vectors, asked


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    people = table(spark, d, "people").select("id", "name", "name_normalized", "known_for_role", "known_for_org")
    vectors = _vectors(spark, d, people)
    asked = people.where("id % 50 = 0").join(vectors, "id").select(c("id").alias("query_id"), c("name").alias("query_text"), c("known_for_role").alias("role"), c("known_for_org").alias("org"), "embedding")
    return people, vectors, asked


def _found(source: str, normal: str, fetch: int) -> str:
    """SQL for the text filter and the similarities: ``best(query_id, id, s, text)``."""
    return rf"""
  n as (select count(*) as n from embeddings), vec as (select id, embedding::double[] as v from {source}, n, embeddings where vec_id = id % n),
  q as (select id as query_id, name, {normal} as text from {source} where id % 50 = 0),
  w as (select query_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from q where text <> ''),
  k2 as (select query_id, case when len(ws) > 1 then list_filter(ws, lambda x: length(x) >= 3) else ws end as ws from w),
  t as (select query_id, u.w, u.i from k2, (select unnest(ws) as w, generate_subscripts(ws, 1) as i) as u),
  term as (select query_id, w from (select *, row_number() over (partition by query_id order by length(w) desc, i) as n from t) where n <= 3),
  cand as (select distinct query_id, id from term, {source} where contains(name_normalized, w)
    union select query_id, id from q, {source} where text = ''),
  sim as (select query_id, cand.id, list_cosine_similarity(a.v, b.v) as s from cand join vec a on a.id = query_id join vec b on b.id = cand.id),
  best as (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) as nth from sim qualify nth <= {fetch})"""


def _ranked(top: int) -> str:
    return f"""with recursive lei as (select id, upper(record['lei']) as lei from organizations), grp as (select lei, min(id) as canon_id from lei where lei is not null group by 1),
  canon as (select grp.lei, list_distinct(list(source)) as sources from grp join lei using (lei) join organizations using (id) group by 1),
  facts as (select id, source, coalesce(record['ticker'], '') as ticker, {N.sql_normalize_org_name('name')} as norm, sources, coalesce(sources, [source]) as every from organizations join lei using (id) left join canon using (lei)),
  {_found('organizations', N.sql_normalize_org_name('name'), 500)},
  scored as (select query_id, id, s, case when q.text = '' then s else 0.3 * s + case when ticker <> '' or coalesce(list_contains(sources, 'sec_edgar'), false) then 0.08 else 0 end + case when list_contains(every, 'gleif') then 0.05 else 0 end
    + case when list_contains(every, 'sec_edgar') then 0.03 else 0 end + case when list_contains(every, 'wikipedia') then 0.02 else 0 end + case when norm = q.text then 0.05 else 0 end end as adjusted from best join facts using (id) join q using (query_id)),
  ranked as (select *, row_number() over (partition by query_id order by round(adjusted, 9) desc, round(s, 9) desc, id) as rank from scored qualify rank <= {top})"""


@query(_ranked(20) + " select query_id, id, round(s, 6) as similarity, round(adjusted, 6) as adjusted, rank from ranked")
def v05_hybrid_search(spark, d):
    """Text filter, similarity and prominence with the sources of the canonical group."""
    orgs, vectors, asked = _organizations(spark, d)
    return search.search_organizations(asked, orgs, vectors).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("adjusted", 6).alias("adjusted"), "rank")


@query("""with lei as (select id, source, record, upper(record['lei']) as lei from organizations), canon as (select lei, list_distinct(list(source)) as sources from lei where lei is not null group by 1)
  select id, round(0.3::double * s.s + case when coalesce(record['ticker'], '') <> '' or coalesce(list_contains(sources, 'sec_edgar'), false) then 0.08 else 0 end + case when list_contains(coalesce(sources, [source]), 'gleif') then 0.05 else 0 end
    + case when list_contains(coalesce(sources, [source]), 'sec_edgar') then 0.03 else 0 end + case when list_contains(coalesce(sources, [source]), 'wikipedia') then 0.02 else 0 end, 6) as score
  from lei left join canon using (lei) join (select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from embeddings) s on s.vec_id = id % (select count(*) from embeddings)""")
def v06_prominence(spark, d):
    """Every organization's prominence for one query vector, the first of the table."""
    orgs, vectors, _ = _organizations(spark, d)
    from ..functions import vectors as V

    first = table(spark, d, "embeddings").where("vec_id = 0").select(c("embedding").alias("q"))  # one row
    canon = orgs.where("canon_id is not null").groupBy("canon_id").agg(F.collect_set("source").alias("sources"))
    rows = orgs.join(canon, "canon_id", "left").join(vectors, "id").join(F.broadcast(first))
    listed = (F.coalesce(F.element_at("record", F.lit("ticker")), F.lit("")) != "") | F.coalesce(F.array_contains("sources", "sec_edgar"), F.lit(False))
    return rows.select("id", F.round(knn.prominence(V.cosine(c("q"), c("embedding")), listed, F.coalesce("sources", F.array("source")), F.lit(False)), 6).alias("score"))


@query(_ranked(20) + """, fit as (select * from ranked where s >= 0.3), one as (select query_id, count(*) as n, first(id order by rank) as id, first(s order by rank) as s from fit group by 1)
  select query_id, id, round(s, 6) as similarity, case when n = 1 and s >= 0.9 then 'single' else 'first' end as outcome from one where (n = 1 and s >= 0.9) or s >= 0.85""")
def l07_org_qualifier(spark, d):
    orgs, vectors, asked = _organizations(spark, d)
    return search.qualify_organizations(asked, orgs, vectors).select("query_id", "id", F.round("score", 6).alias("similarity"), "outcome")


@query(_ranked(5) + " select query_id, first(id order by rank) as id, round(first(s order by rank), 6) as similarity from ranked where s >= 0.7 group by 1")
def l09_org_resolver(spark, d):
    orgs, vectors, asked = _organizations(spark, d)
    return search.resolve_organizations(asked, orgs, vectors).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


_ALIKE = " or ".join(f"(x in ({', '.join(map(repr, same))}) and y in ({', '.join(map(repr, same))}))" for same in search.SAME_ROLES)
_PERSONS = f"""with recursive {_found('people', N.sql_normalize_person_name('name'), 30)},
  p as (select id, {N.sql_normalize_person_name('name')} as norm, lower(trim(known_for_role)) as r, known_for_org as o, {N.sql_normalize_org_name('known_for_org')} as onorm from people),
  pair as (select query_id, best.id, s, a.norm = b.norm as same_name, a.r as x, b.r as y, coalesce(a.o <> '' and b.o <> '' and (contains(a.onorm, b.onorm) or contains(b.onorm, a.onorm)), false) as same_org
    from best join p a on a.id = query_id join p b on b.id = best.id where s >= 0.5),
  scored as (select query_id, id, s, same_org, least(1.0, s + case when same_name then 0.25 else 0 end + case when coalesce(x <> '' and y <> '' and (contains(x, y) or contains(y, x) or {_ALIKE}), false) then 0.1 else 0 end + case when same_org then 0.15 else 0 end) as adjusted from pair),
  ranked as (select *, row_number() over (partition by query_id order by round(adjusted, 9) desc, same_org desc, round(s, 9) desc, id) as rank from scored)"""


@query(_PERSONS + " select query_id, id, round(s, 6) as similarity, rank from ranked")
def v07_person_search(spark, d):
    people, vectors, asked = _people(spark, d)
    return search.search_people(asked, people, vectors).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(_PERSONS + " select query_id, id, round(adjusted, 6) as score from ranked")
def v08_person_match_score(spark, d):
    people, vectors, asked = _people(spark, d)
    return search.search_people(asked, people, vectors).select("query_id", "id", F.round("adjusted", 6).alias("score"))


@query(_PERSONS + """, one as (select query_id, count(*) as n, first(id order by rank) as id, first(adjusted order by rank) as s from ranked group by 1)
  select query_id, id, round(s, 6) as score, case when n = 1 and s >= 0.9 then 'single' else 'first' end as outcome from one where s >= 0.85""")
def l08_person_qualifier(spark, d):
    people, vectors, asked = _people(spark, d)
    return search.qualify_people(asked, people, vectors).select("query_id", "id", F.round("score", 6).alias("score"), "outcome")
