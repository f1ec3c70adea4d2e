"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .pack import numbered


def sainte_lague(weights: dict, seats: int) -> dict:
    """``seats`` divided by ``weights``: each seat goes to the highest quotient weight / (2 s + 1), ties to the smaller key.

    With the divisor total / (seats - keys / 2) rounding gives at most ``seats`` and at least ``keys`` less, and never a key
    more than the method does. Only that rest goes one by one, so the cost depends on the keys and not on the seats.
    """
    live = {k: Fraction(w).limit_denominator(10**12) for k, w in weights.items() if w and w > 0}
    out = dict.fromkeys(weights, 0)
    if not live or seats <= 0:
        return out
    total = sum(live.values())
    for k, w in live.items():
        out[k] = max(0, int(w * (2 * seats - len(live)) / (2 * total) + Fraction(1, 2)))
    heap = [(-live[k] / (2 * out[k] + 1), k) for k in live]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, k = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-live[k] / (2 * out[k] + 1), k))
    return out


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], block: int, total: int | None = None) -> tuple[dict[str, int], int]:
    """Blocks of ``block`` tokens for each listed source, and their sum.

    Without ``total`` the mix is as large as the repeat caps let it be with every share met; a source without tokens
    gives its share to the others in proportion. With ``total`` (tokens), sources that cannot fill their quota within
    the cap are set to the cap and what they leave is apportioned among the others again.
    """
    live = {k: s for k, (s, r) in targets.items() if s > 0 and totals.get(k, 0) > 0 and r}
    caps = {k: totals[k] * targets[k][1] // block for k in live}
    if not live:
        return {}, 0
    if total is None:
        weight = sum(live.values())
        seats = min(int(caps[k] * weight / s) for k, s in live.items())
        given = sainte_lague(live, seats)
        while any(given[k] > caps[k] for k in given) and seats:
            seats -= 1
            given = sainte_lague(live, seats)
        return given, seats
    seats, fixed, free = total // block, {}, dict(live)
    while True:
        given = sainte_lague(free, seats - sum(fixed.values()))
        over = [k for k in given if given[k] > caps[k]]
        if not over:
            return given | fixed, sum(given.values()) + sum(fixed.values())
        for k in over:
            fixed[k] = caps[k]
            del free[k]


def shard_quotas(per: DataFrame, seats: DataFrame) -> DataFrame:
    """``(_source, shard, n, quota)``: Sainte-Laguë of each source's seats over its shards, as DataFrames.

    ``per`` has ``_source, shard, n`` (tokens), ``seats`` has ``_source, seats`` for the listed sources. As in ``sainte_lague`` a first
    divisor gives all but at most as many seats as there are shards; the quotients that the others can go to, a few a
    shard, are ranked by a range sort, and the highest get them.
    """
    whole = per.groupBy("_source").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    known = per.join(whole, "_source").join(F.broadcast(seats), "_source")  # a row a listed source
    first = F.greatest(F.lit(0), F.floor(F.col("n") * (2 * F.col("seats") - F.col("k")) / (2 * F.col("total")) + 0.5))
    known = cut(known.withColumn("given", first.cast("bigint")))
    rest = known.groupBy("_source").agg((F.first("seats") - F.sum("given")).alias("rest"))
    turns = F.explode(F.sequence(F.lit(1), (F.ceil(F.col("k") * F.col("n") / F.col("total")) + 2).cast("int")))
    asked = known.select("_source", "shard", "n", "given", turns.alias("turn")).withColumn("quotient", F.col("n") / (2 * (F.col("given") + F.col("turn")) - 1))
    ranked = cut(numbered(asked.select("_source", "shard", "quotient"), [F.col("_source"), -F.col("quotient"), F.col("shard")], F.lit(1).cast("bigint"), "at"))
    begins = ranked.groupBy("_source").agg(F.min("at").alias("begin")).join(rest, "_source")
    more = ranked.join(F.broadcast(begins), "_source").where("at - begin < rest").groupBy("_source", "shard").agg(F.count(F.lit(1)).alias("more"))
    return cut(known.join(more, ["_source", "shard"], "left").select("_source", "shard", "n", (F.col("given") + F.coalesce("more", F.lit(0))).alias("quota")))


def fine_block(totals: dict[str, int], targets: dict[str, tuple[float, int]], block: int) -> int:
    """The largest block up to ``block`` of which the cap of every source holds 1024, down to one token: rounding caps to whole blocks then costs a source next to nothing."""
    caps = [totals[k] * r for k, (s, r) in targets.items() if s > 0 and totals.get(k, 0) > 0 and r]
    return max(1, min([block, *(c // 1024 for c in caps)]))


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens",
    total: int | None = None, block: int = 1024, shard_tokens: int = 8_000_000, seed: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, report)``: how often each document is used, and the shares reached.

    ``documents`` has a row for each document used at least once: id, source, size, ``uses`` (at most the source's
    ``max_repeats``). ``report`` has a row for each listed source: ``target_share``, tokens available, ``quota_tokens``,
    ``mixed_tokens``, ``actual_share``, ``documents`` and the largest ``uses``.

    ``block`` is the largest block; it is made smaller where a source is scarce (``fine_block``).

    The driver apportions blocks to the listed sources; each source's go to its shards of about ``shard_tokens`` tokens by
    the same method, distributed (``shard_quotas``). Documents of a shard stand in a seeded order that is cut into
    blocks; a shard's quota is its first blocks, which the seed chooses. A source of any size is spread over its shards by a hash of the id, so a source that holds a
    third of all rows is selected by many tasks. Within a shard documents go in seeded order; every document is used as
    often as the quota covers the whole shard, and the first ones once more, up to the quota. A document that straddles
    the end is used if its larger part lies inside.

    Rows whose source is NULL or not listed are not used; NULL sizes count as 0 and such rows are not used; a listed source
    without documents is reported with 0; empty tables give empty documents. Ties in the seeded order go to the smaller
    id. Repeated ids are separate items of the same shard. Extra columns are not read.
    """
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    spark = docs.sparkSession
    size = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    sized = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size")).where("_size > 0").where(F.col("_source").isin(list(wanted))))
    totals = {r["_source"]: r["n"] for r in sized.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}  # one row per listed source
    block = fine_block(totals, wanted, block)
    given, _ = quotas(totals, wanted, block, total)
    shards = spark.createDataFrame([(k, max(1, -(-n // shard_tokens))) for k, n in totals.items()] or [("", 1)], "_source string, shards bigint")
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    placed = sized.join(F.broadcast(shards), "_source").withColumn("_order", order).withColumn("shard", F.pmod(F.xxhash64("_order"), F.col("shards")))
    per = cut(placed.groupBy("_source", "shard").agg(F.sum("_size").alias("n")))
    seats = spark.createDataFrame([(k, int(given.get(k, 0))) for k in totals] or [("", 0)], "_source string, seats bigint")
    limits = shard_quotas(per, seats).select("_source", "shard", (F.col("quota") * block).alias("quota"), F.col("n").alias("tokens"))
    start = F.coalesce(F.sum("_size").over(Window.partitionBy("_source", "shard").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = F.floor(F.col("quota") / F.col("tokens"))
    rest = F.col("quota") - F.col("rounds") * F.col("tokens")
    repeats = spark.createDataFrame([(k, int(r or 0)) for k, (_, r) in wanted.items()] or [("", 0)], "_source string, max_repeats int")
    used = (
        placed.withColumn("start", start)
        .join(limits, ["_source", "shard"])
        .join(F.broadcast(repeats), "_source")
        .withColumn("rounds", rounds)
        .withColumn("uses", F.least(F.col("rounds") + F.when(F.col("start") * 2 + F.col("_size") <= rest * 2, 1).otherwise(0), F.col("max_repeats")).cast("int"))
        .where("uses > 0")
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias(size_col), "uses")
    )
    used = cut(used)
    reached = used.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.col(size_col) * F.col("uses")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses")
    )
    base = spark.createDataFrame([(k, s, m, int(totals.get(k, 0)), int(given.get(k, 0)) * block) for k, (s, m) in wanted.items()],
                                 "source string, target_share double, max_repeats int, tokens bigint, quota_tokens bigint")
    whole = reached.agg(F.sum("mixed_tokens").alias("whole"))
    report = (
        base.join(F.broadcast(reached), "source", "left").join(F.broadcast(whole))
        .select("source", "target_share", "max_repeats", "tokens", "quota_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("bigint").alias("mixed_tokens"),
                F.coalesce(F.round(F.col("mixed_tokens") / F.col("whole"), 6), F.lit(0.0)).alias("actual_share"),
                F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    )
    return used, report
