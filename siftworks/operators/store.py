"""Writes as DataFrame transformations: upserts, inserts that ignore, updates, deletes and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return out


def last_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; NULL keys are equal. A ``max_by`` with map-side combining, not a sort of each key's rows."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys, the last of several wins; NULL keys are equal."""
    latest = last_of_each(new, keys, order)
    kept = old.alias("o").join(latest.alias("n"), _same(keys), "left_anti")
    return kept.unionByName(latest)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` doesn't have are added, the first of several."""
    whole = F.struct(*[F.col(c) for c in new.columns])
    first = new.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
    return old.unionByName(first.alias("o").join(old.alias("n"), _same(keys), "left_anti"))


def get_or_create(dim: DataFrame, names: DataFrame, key: str, id_col: str) -> DataFrame:
    """``dim`` with a row for each name that it lacks; new ids follow the largest one in order of names.

    Ids come from a range sort and the counts of its partitions, so the new names are never in one task.
    """
    fresh = names.select(key).where(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    ordered = fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    counts = ordered.groupBy("_p").count()
    before = counts.select("_p", (F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = ordered.withColumn("_n", place).join(F.broadcast(before), "_p").join(F.broadcast(top))
    return dim.select(id_col, key).unionByName(numbered.select((F.col("_top") + F.col("_before") + F.col("_n")).cast("bigint").alias(id_col), key))


def coalesce_update(old: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the update where it has a value, else stay, else become ''."""
    named = updates.select(key, *[F.col(x).alias(f"_u_{x}") for x in columns])
    joined = old.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_u_{x}", x, F.lit("")).alias(x) if x in columns else F.col(x) for x in old.columns])


def cache_live(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest entry of each key that isn't empty and not older than ``hours``."""
    live = entries.where((F.length("result") > 0) & (F.col("created_at") >= now - F.expr(f"interval {hours} hours")))
    return last_of_each(live, ["cache_key"], [F.col("created_at"), F.col("result")])


def cache_within(entries: DataFrame, capacity: int) -> DataFrame:
    """The most recently used entries whose sizes, added up in that order, stay within ``capacity``.

    Recency is range-sorted; each partition's total is known before its running sum, so no task sorts everything.
    """
    ordered = entries.repartitionByRange(F.desc("used_at"), F.asc("cache_key")).withColumn("_p", F.spark_partition_id())
    totals = ordered.groupBy("_p").agg(F.sum("size").alias("_n"))
    before = totals.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("size").over(Window.partitionBy("_p").orderBy(F.desc("used_at"), "cache_key"))
    return ordered.join(F.broadcast(before), "_p").withColumn("running", run + F.col("_before")).where(F.col("running") <= capacity).drop("_p", "_before")
