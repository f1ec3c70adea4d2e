"""Connected components, and canonical records built from shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` by alternating large-star and small-star rounds; ``component`` is the smallest node.

    Large-star links a node's larger neighbours to the smallest one, small-star the smaller ones; the edges only ever
    move to smaller ends and stop changing when each component is a star. Both are one aggregation and one join on the
    same key, with the minimum combined map-side. Loops, NULL ends and repeats are ignored.
    """
    live = edges.select(F.col(left).cast("bigint").alias("a"), F.col(right).cast("bigint").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    live = cut(live)
    state = None
    while True:
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(live.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        seen = Observation()
        marked = small.select(F.col("v").alias("a"), F.col("u").alias("b")).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        live = cut(marked, replaces=live)
        if (now := (seen.get["n"], seen.get["h"])) == state:
            return live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now


def star_edges(rows: DataFrame, keys: list[Column], id_col: str = "id") -> DataFrame:
    """``(a, b)``: each row linked to the smallest id that has one of its keys; NULL keys link nothing. One edge a row and key."""
    tagged = F.array_compact(F.array(*[F.when(k.isNotNull(), F.xxhash64(F.lit(i), k)) for i, k in enumerate(keys)]))
    held = rows.select(F.col(id_col).alias("b"), F.explode(tagged).alias("key"))
    head = held.groupBy("key").agg(F.min("b").alias("a"))
    return held.join(head, "key").where("a <> b").select("a", "b").distinct()


def pick_canonical(rows: DataFrame, components: DataFrame, priority: Column, id_col: str = "id") -> DataFrame:
    """``rows`` with ``canon_id`` (the best row of the component by priority, then id) and ``canon_size`` (on that row; 1 on the others)."""
    joined = rows.join(components.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("component", id_col)).withColumn("_p", priority)
    best = joined.groupBy("component").agg(F.min(F.struct("_p", id_col)).alias("best"), F.count(F.lit(1)).alias("n"))
    out = joined.join(best, "component").withColumn("canon_id", F.col(f"best.{id_col}"))
    return out.withColumn("canon_size", F.when(F.col(id_col) == F.col("canon_id"), F.col("n")).otherwise(1)).drop("component", "_p", "best", "n")
