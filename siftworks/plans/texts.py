"""Queries over vectors, labels, chunks, exports and parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..operators import statements as S
from ..operators.chunks import chunk_documents
from ..operators.knn import nearest
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


_QUERY_SET = "vec_id % 50 = 0"
_KNN = f"""k as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where q.{_QUERY_SET}),
  r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as n from k)"""


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def v01_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(c("embedding")), 6).alias("norm"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def v02_cosine(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(c("embedding"), c("other")), 6).alias("cosine"))


@query("select vec_id, array_to_string(list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double * 127, 0)))::int), ',') as quantized from embeddings")
def v03_quantize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(V.quantize(c("embedding")).cast("array<string>"), ",").alias("quantized"))


@query(f"with {_KNN} select query_id, vec_id, round(s, 6) as similarity from r where n <= 10")
def t01_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    found = nearest(e.where(_QUERY_SET).select(c("vec_id").alias("query_id"), "embedding"), e, 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""with q as (select vec_id, label, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double * 127, 0)))) as v from embeddings),
  k as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.v::double[], b.v::double[]) as s from q a, q b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as n from k)
  select query_id, vec_id, round(1 - s, 6) as distance from r where n <= 10""")
def v04_int8_knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.quantize(c("embedding")).cast("array<float>").alias("embedding"))
    found = nearest(e.where(_QUERY_SET).select(c("vec_id").alias("query_id"), "embedding"), e, 10)
    return found.select("query_id", "vec_id", F.round(1 - c("similarity"), 6).alias("distance"))


@query("""with c as (select label, i, avg(x) as m from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2), v as (select label, list(m order by i) as centre from c group by 1),
  s as (select e.vec_id, v.label, list_cosine_similarity(e.embedding::double[], v.centre) as s from embeddings e, v), r as (select *, row_number() over (partition by vec_id order by round(s, 9) desc, label) as k from s)
  select vec_id, label, round(1 / (1 + exp(-25.0 * ((s + 1) / 2 - 0.65))), 6) as confidence from r where k <= 3""")
def v09_taxonomy(spark, d):
    """The three nearest label centres of each vector with calibrated confidence. There is one centre a label."""
    e = table(spark, d, "embeddings")
    width = e.select(F.max(F.size("embedding"))).first()[0] or 0
    centres = e.groupBy("label").agg(F.array(*[F.avg(c("embedding")[i].cast("double")) for i in range(width)]).alias("centre"))
    scored = e.select("vec_id", "embedding").join(F.broadcast(centres)).select("vec_id", "label", V.cosine(c("embedding"), c("centre")).alias("s"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("s", 9)).alias("o"), "label", "s"))), 1, 3)
    return scored.groupBy("vec_id").agg(best.alias("r")).select("vec_id", F.explode("r").alias("r")).select("vec_id", "r.label", F.round(V.calibrated(c("r.s")), 6).alias("confidence"))


@query(f"with {_KNN} select query_id, vec_id, round(s, 6) as similarity from r where n = 2 and s >= 0.1")
def v12_nearest_label(spark, d):
    e = table(spark, d, "embeddings")
    found = nearest(e.where(_QUERY_SET).select(c("vec_id").alias("query_id"), "embedding"), e, 2)
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")))
    return ranked.where("n = 2 and similarity >= 0.1").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {SQL_TRIPLES} select seq, case when (seq % 89) / 89.0::double > confidence + 0.05 then object else subject end as subject, case when (seq % 89) / 89.0::double > confidence + 0.05 then subject else object end as object from triples")
def v15_reversal(spark, d):
    turned = (c("seq") % 89) / 89.0 > c("confidence") + 0.05
    return triples(spark, d).select("seq", F.when(turned, c("object")).otherwise(c("subject")).alias("subject"), F.when(turned, c("subject")).otherwise(c("object")).alias("object"))


@query(f"with {SQL_TRIPLES} select seq, round(case when source_text is null then 0.5 else 0.5 * confidence + 0.25 * contains(source_text, subject)::int + 0.25 * contains(source_text, object)::int end, 6) as score from triples")
def v16_triple_score(spark, d):
    inside = lambda x: F.contains("source_text", c(x)).cast("int")
    return triples(spark, d).select("seq", F.round(F.when(c("source_text").isNull(), 0.5).otherwise(0.5 * c("confidence") + 0.25 * inside("subject") + 0.25 * inside("object")), 6).alias("score"))


@query(f"with {SQL_TRIPLES} select seq, instr(source_text, subject) - 1 as start_char, instr(source_text, object) + length(object) - 1 as end_char from triples")
def v17_evidence_span(spark, d):
    at = lambda x: F.expr(f"instr(source_text, {x})")
    return triples(spark, d).select("seq", (at("subject") - 1).cast("bigint").alias("start_char"), (at("object") + F.length("object") - 1).cast("bigint").alias("end_char"))


def _sql_hits(patterns):
    return " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in patterns)


@query(f"""with k as (select doc_id, {_sql_hits(L.POSITIVE)} as p, {_sql_hits(L.NEGATIVE)} as n, {_sql_hits(L.NEUTRAL)} as u from documents where text is not null)
  select doc_id, case when p > n and p > u then 'positive' when n > p and n > u then 'negative' else 'neutral' end as label,
    round(case when p + n + u = 0 then 0.5 when p > n and p > u then least(0.6 + p / (p + n + u) * 0.3, 0.9) when n > p and n > u then least(0.6 + n / (p + n + u) * 0.3, 0.9) else 0.6 end, 6) as confidence from k""")
def l01_sentiment(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", L.sentiment(c("text")).alias("s"))
    return docs.select("doc_id", "s.label", F.round("s.confidence", 6).alias("confidence"))


@query("select doc_id, coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in L.ROLE_PATTERNS) + ") as role from documents where text is not null")
def l05_role_in_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.role_in_text(c("text")).alias("role"))


@query("""select p.id, coalesce(o.name, r.title, nullif(p.known_for_org, ''), 'unknown') as qualified from people p left join organizations o on o.id = p.known_for_org_id left join ref_roles r on r.title = p.known_for_role""")
def l06_first_qualifier(spark, d):
    orgs = table(spark, d, "organizations").select(c("id").alias("known_for_org_id"), c("name").alias("org"))
    roles = table(spark, d, "ref_roles").select(c("title").alias("known_for_role"), c("title").alias("role"))
    people = table(spark, d, "people").select("id", "known_for_org_id", "known_for_role", "known_for_org")
    joined = people.join(orgs, "known_for_org_id", "left").join(F.broadcast(roles), "known_for_role", "left")
    return joined.select("id", F.coalesce("org", "role", F.nullif("known_for_org", F.lit("")), F.lit("unknown")).alias("qualified"))


@query()
def c02_chunks(spark, d):
    return chunk_documents(table(spark, d, "documents")).drop("text")


_HEAD = "substr(text, 1, 1000)"


@query(rf"""with t as (select doc_id, text, {_HEAD} as h from documents where text is not null), m as (select *, greatest(case when contains(h, '. ') then length(regexp_extract(h, '(?s)^(.*)\. ', 1)) + 1 else 0 end, case when contains(h, chr(10)) then length(regexp_extract(h, '(?s)^(.*)\n', 1)) + 1 else 0 end) as cut_at from t)
  select doc_id, sha256(case when length(text) <= 1000 then text when cut_at > 700 then substr(text, 1, cut_at) else h end) as head_hash from m""")
def c06_truncate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(L.truncate_at_sentence(c("text"), 1000), 256).alias("head_hash"))


_csv = lambda x: f"case when regexp_matches(coalesce({x}, ''), '[\",\\n\\r]') then '\"' || replace(coalesce({x}, ''), '\"', '\"\"') || '\"' else coalesce({x}, '') end"


@query(f"with {SQL_TRIPLES} select seq, {_csv('subject')} || ',' || {_csv('predicate')} || ',' || {_csv('object')} || ',' || printf('%.3f', confidence) as line from triples")
def k09_csv(spark, d):
    return triples(spark, d).select("seq", S.csv_line(c("subject"), c("predicate"), c("object"), F.format_string("%.3f", "confidence")).alias("line"))


@query("select id, to_json({'id': id, 'source': source, 'region': region})::varchar as line from organizations where region is not null and region not like '%\\%' and source is not null")
def k10_json(spark, d):
    orgs = table(spark, d, "organizations").where(c("region").isNotNull() & ~F.contains("region", F.lit("\\")) & c("source").isNotNull())
    return orgs.select("id", F.to_json(F.struct("id", "source", "region")).alias("line"))


@query()
def k11_xml(spark, d):
    return triples(spark, d).select("seq", S.to_xml(c("subject"), c("predicate"), c("object"), c("source_text")).alias("xml"))


@query(f"""with {SQL_TRIPLES}, f as (select entity, min(seq) as first_seq from (select seq, subject as entity from triples union all select seq, object from triples) group by 1),
  n as (select entity, row_number() over (order by first_seq, encode(entity)) - 1 as node from f)
  select t.seq, '(n' || a.node || ')-[:' || regexp_replace(upper(predicate), '[^A-Z0-9]', '_', 'g') || ']->(n' || b.node || ')' as relation from triples t join n a on a.entity = t.subject join n b on b.entity = t.object""")
def k12_cypher(spark, d):
    rows = triples(spark, d)
    nodes = S.numbered_nodes(rows)
    a, b = nodes.select(c("entity").alias("subject"), c("node").alias("a")), nodes.select(c("entity").alias("object"), c("node").alias("b"))
    return rows.join(a, "subject").join(b, "object").select("seq", F.format_string("(n%d)-[:%s]->(n%d)", "a", S.relation_type(c("predicate")), "b").alias("relation"))


@query(f"with {SQL_TRIPLES} select entity, min(seq) as first_seq from (select seq, subject as entity from triples union all select seq, object from triples) group by 1")
def k13_graph_nodes(spark, d):
    return S.graph_nodes(triples(spark, d))


@query(f"with {SQL_TRIPLES} select seq, 0 as position, subject, 'UNKNOWN' as subject_type, predicate, object, 'UNKNOWN' as object_type, source_text as text from triples where trim(subject) <> '' and trim(object) <> '' and not regexp_matches(subject || predicate || object, '^\\s|\\s$|[&<\\t]|\\s\\s')  and regexp_full_match(subject || '|' || predicate || '|' || object, '(\\S.*\\S|\\S)\\|(\\S.*\\S|\\S)\\|(\\S.*\\S|\\S)')")
def s52_parse_xml(spark, d):
    """Statements written as XML and read back."""
    rows = triples(spark, d).where("trim(subject) <> '' and trim(object) <> ''")
    rows = rows.where(~F.concat("subject", "predicate", "object").rlike(r"^\s|\s$|[&<\t]|\s\s") & F.concat_ws("|", "subject", "predicate", "object").rlike(r"^(\S.*\S|\S)\|(\S.*\S|\S)\|(\S.*\S|\S)$"))
    xml = rows.select("seq", F.concat(F.lit("<statements>"), S.to_xml(c("subject"), c("predicate"), c("object"), c("source_text")), F.lit("</statements>")).alias("xml"))
    return S.parse_xml(xml, "xml").drop("xml")


@query(f"with {SQL_TRIPLES} select seq, source_text as sentence from triples where not regexp_matches(source_text, '[&<>\"'']')")
def s54_sentences(spark, d):
    rows = triples(spark, d).where(~c("source_text").rlike("[&<>\"']"))
    xml = rows.select("seq", S.to_xml(c("subject"), c("predicate"), c("object"), c("source_text")).alias("xml"))
    return xml.select("seq", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<stmt>.*?<text>(.*?)</text>.*?</stmt>"), F.lit(1))).alias("sentence"))


@query(f"with {SQL_TRIPLES} select seq, subject, predicate, object, subject || ' ' || predicate || ' ' || object as text from triples")
def s55_parse_json(spark, d):
    rows = triples(spark, d)
    raw = rows.select("seq", F.to_json(F.struct(F.array(F.struct("subject", "predicate", "object")).alias("statements"))).alias("raw"))
    return S.parse_any(raw, "raw").drop("raw")


@query("select doc_id, lower(coalesce(title, '')) like '%report%' as is_report, case when lower(regexp_replace(coalesce(url, ''), '[?#].*', '')) like '%.pdf' then 'pdf' else 'html' end as kind from documents")
def s41_content_kind(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("report")).alias("is_report"), L.content_kind(c("url"), F.lit(None).cast("string")).alias("kind"))


@query("select doc_id, length(text) <= 50000 and (" + " or ".join(f"contains(lower(text), '{p}')" for p in L.CHALLENGES) + ") as challenged from documents where text is not null")
def s42_challenge(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.challenge_page(c("text")).alias("challenged"))
