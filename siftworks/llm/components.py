"""Consolidating pairwise matches into groups: deterministic Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import cut


def _collapse(hooks: DataFrame) -> DataFrame:
    """Follow ``parent`` to the root of every tree by pointer doubling; the number of rounds is the log of the height."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        seen = Observation()
        jumped = (
            hooks.join(up, "parent", "left")
            .select("node", F.coalesce("above", "parent").alias("to"), "parent")
            .observe(seen, F.count_if(F.col("to") != F.col("parent")).alias("moved"))
            .select("node", F.col("to").alias("parent"))
        )
        hooks = cut(jumped, replaces=hooks)
        if seen.get["moved"] == 0:
            return hooks


def components(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``(node, root)`` for each node of an undirected graph given as pairs; ``root`` is the smallest node of its component.

    Each round every component hooks onto its smallest outgoing edge. Edges are ordered by (smaller end, larger end), so
    the hooks contain no cycle but the mutual pair that holds a tree's smallest edge, whose smaller end becomes the root.
    Trees collapse by pointer doubling, edges are relabelled, loops and repeats dropped, until no edge remains. The
    number of components that still have edges at least halves each round, so rounds and data moved are bounded by the
    logarithm and a small multiple of the pairs. The label maps of the rounds are composed backwards, from the smallest.

    Skew: the smallest edge of a node is a ``min`` with map-side combining, so a node that holds a third of all pairs
    costs its task one row per map task. The relabelling joins have unique keys on the map side and leave the splitting
    of hot keys to AQE; nothing is collected.

    Edge cases: pairs with a NULL end or equal ends, and repeats in either direction, are ignored; an empty input gives
    an empty result; other columns are ignored. Ends are cast to BIGINT.
    """
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    edges = cut(
        pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), a.isNull().alias("x"), b.isNull().alias("y"))
        .where("not x and not y and u <> v")
        .select("u", "v")
        .distinct()
    )
    maps: list[DataFrame] = []
    while True:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(edges.select("v", "u"))
        seen = Observation()
        pick = ends.groupBy("node").agg(F.min("other").alias("parent")).observe(seen, F.count(F.lit(1)).alias("nodes"))
        picked = cut(pick)
        if seen.get["nodes"] == 0:
            break
        back = picked.select(F.col("node").alias("parent"), F.col("parent").alias("back"))
        rooted = picked.join(back, "parent").select(
            "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent")
        )
        hooks = _collapse(cut(rooted, replaces=picked))
        maps.append(hooks)
        to_u = hooks.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        to_v = hooks.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        edges = cut(
            edges.join(to_u, "u").join(to_v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(),
            replaces=edges,
        )
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        after = whole.select(F.col("node").alias("parent"), F.col("parent").alias("last"))
        whole = cut(earlier.join(after, "parent", "left").select("node", F.coalesce("last", "parent").alias("parent")), replaces=whole)
    return whole.select("node", F.col("parent").alias("root"))


def consolidate(records: DataFrame, matches: DataFrame, id_col: str = "id", left: str = "left_id", right: str = "right_id", match: str = "is_match") -> DataFrame:
    """``(id, canon_id, canon_size)`` for each record that a positive match joins to another record.

    ``canon_id`` is the smallest id joined directly or through others, ``canon_size`` their number. Matches whose
    ``match`` is false or NULL, whose ends are NULL or equal, or name no record do not count. Records without a match
    have no row. Repeated record ids count once.
    """
    ids = records.select(F.col(id_col).cast("bigint").alias("node")).where("node is not null").distinct()
    pairs = matches.where(F.col(match)).select(F.col(left).cast("bigint").alias("left"), F.col(right).cast("bigint").alias("right"))
    for side in ("left", "right"):
        pairs = pairs.join(ids.withColumnRenamed("node", side), side, "left_semi")
    found = components(pairs)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("canon_size"))
    return found.join(sizes, "root").select(F.col("node").alias("id"), F.col("root").alias("canon_id"), "canon_size")
