"""Queries over the locations' hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import hierarchy, paths
from ..tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "locations")).select("id", "root_id", "depth", "status")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of each location, with its type."""
    locations = table(spark, d, "locations")
    found = hierarchy(locations)
    kind = locations.select("id", F.lower(F.trim("simplified_type")).alias("simplified_type"))
    return found.join(paths(found), "id", "left").join(kind, "id", "left").select("id", "simplified_type", "status", "root_id", "depth", "n_descendants", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair of the trees."""
    found = paths(hierarchy(table(spark, d, "locations")))
    return found.select(F.explode("path").alias("ancestor_id"), F.col("id").alias("descendant_id")).where("ancestor_id <> descendant_id")


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}

_REACH = """
with recursive link as (
  select distinct l.id as child, p.p as parent from locations l, unnest(l.parent_ids) as p(p) where p.p in (select id from locations)),
reach as (
  select child, parent from link
  union
  select r.child, l.parent from reach r join link l on l.child = r.parent),
circle as (select child as id from reach where child = parent),
bad as (
  select id, 'cycle' as status from circle
  union
  select distinct r.child, 'below_cycle' from reach r where r.parent in (select id from circle) and r.child not in (select id from circle)),
good as (select id from locations where id not in (select id from bad)),
walk as (
  select id, id as root_id, 0 as depth from good where id not in (select child from link)
  union
  select l.child, w.root_id, w.depth + 1 from walk w join link l on l.parent = w.id where l.child in (select id from good)),
deep as (select id, max(depth) as depth, arg_max(root_id, depth) as root_id from walk group by id)
"""

ORACLES = {
    "p2_found": _REACH + "select id, root_id::bigint as root_id, depth::bigint as depth, 'tree' as status from deep union all select id, -1, -1, status from bad",
    "p2_paths": _REACH + """,
direct as (
  select l.child as id, first(l.parent order by d.depth desc, l.parent) as parent
  from link l join deep d on d.id = l.parent where l.child in (select id from good) group by l.child),
way as (
  select id, id::varchar as path, id as root_id, 0 as steps from good where id not in (select child from link)
  union all
  select t.id, w.path || '/' || t.id, w.root_id, w.steps + 1 from way w join direct t on t.parent = w.id),
below as (select a.a::bigint as id, count(*) - 1 as n from way, unnest(string_split(path, '/')) as a(a) group by all)
select l.id, lower(trim(l.simplified_type)) as simplified_type, coalesce(b.status, 'tree') as status, coalesce(w.root_id, -1)::bigint as root_id,
  coalesce(w.steps, -1)::bigint as depth, coalesce(n.n, -1)::bigint as n_descendants, w.path
from locations l left join bad b on b.id = l.id left join way w on w.id = l.id left join below n on n.id = l.id""",
    "p2_descendants": _REACH + "select r.parent as ancestor_id, r.child as descendant_id from reach r where r.child in (select id from deep)",
}
