"""Filling fixed-capacity containers: bulk-synchronous best-fit over range-sorted documents and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..tables import cut, ship

GAP, ITEM = 0, 1
SWEPT = "p int, kind int, key bigint, size bigint, used bigint, bin bigint, nth bigint"


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition of the sorted line of gaps and items, from the largest down: items take the nearest gap before them.

    The open gaps are a stack; an item takes its top, the smallest gap seen that holds it, so every gap gets at most one
    item. Rows come out with the ``bin`` an item got; what finds no partner here is numbered by ``nth``, items from
    the first on, gaps from the bottom of the stack.
    """
    stack: list[tuple[int, int, int]] = []
    part, waiting = 0, 0
    for batch in batches:
        out = []
        for part, kind, key, size, used in batch[["p", "kind", "key", "size", "used"]].itertuples(index=False, name=None):
            if kind == GAP:
                stack.append((key, size, used))
            elif stack:
                bin_, gap, before = stack.pop()
                out.append((part, ITEM, key, size, before, bin_, gap))
            else:
                out.append((part, ITEM, key, size, 0, None, waiting))
                waiting += 1
        yield _frame(out)
    yield _frame([(part, GAP, key, gap, used, None, k) for k, (key, gap, used) in enumerate(stack)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["p", "kind", "key", "size", "used", "bin", "nth"])
    return out.astype({"bin": "Int64"})


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Partners across partitions, from ``(p, items, gaps)`` left over in each: runs ``(p, first item, items, gap's p, its top gap)``, the same stack over counts."""
    stack: list[list[int]] = []
    runs = []
    for p, items, gaps in sorted(left):
        at = 0
        while at < items and stack:
            q, n = stack[-1]
            take = min(items - at, n)
            runs.append((p, at, take, q, n - 1))
            at, stack[-1][1] = at + take, n - take
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([p, gaps])
    return runs


def numbered(df: DataFrame, by: list[Column], weight: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``weight`` before each row in the ascending order ``by``: sums inside range partitions, and one row a partition for where each begins."""
    spark = df.sparkSession
    order = [f"_o{i}" for i in range(len(by))]
    keyed = df.withColumns({o: c for o, c in zip(order, by)} | {"_w": weight})
    parted = cut(keyed.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    begins, total = [], 0
    for r in sorted(parted.groupBy("_p").agg(F.sum("_w").alias("n")).collect()):  # a row a partition
        begins.append((r["_p"], total))
        total += r["n"]
    within = F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = spark.createDataFrame(begins or [(0, 0)], "_p int, _begin bigint")
    return parted.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "_p").withColumn(name, F.col("_begin") + F.col("_within")).drop("_p", "_w", "_begin", "_within", *order)


def _matched(items: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One round: ``(placed, items left, gaps, how many were placed)``; ``placed`` has ``key, size, bin, offset``.

    Gaps and items are one line, range-sorted by falling size, a gap before the items of its size, items by rank and gaps by
    falling number. Each partition is swept, the rest is matched across partitions from two counts a partition. That is
    the matching of brackets, which the order alone decides: the partitions don't.
    """
    spark = items.sparkSession
    line = items.select(F.lit(ITEM).alias("kind"), "key", "size", F.lit(0).cast("bigint").alias("used"), F.col("key").alias("turn"))
    line = line.unionByName(gaps.select(F.lit(GAP).alias("kind"), F.col("bin").alias("key"), F.col("gap").alias("size"), "used", (-F.col("bin")).alias("turn")))
    order = [F.desc("size"), F.asc("kind"), F.asc("turn")]
    seen = Observation()
    swept = line.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).mapInPandas(sweep, SWEPT)
    swept = cut(swept.observe(seen, F.count("bin").alias("n")))
    counts = swept.where("bin is null").groupBy("p").agg(F.count_if(F.col("kind") == ITEM).alias("items"), F.count_if(F.col("kind") == GAP).alias("gaps")).collect()  # a row a partition
    runs = across([tuple(r) for r in counts])
    open_items, open_gaps = swept.where(f"bin is null and kind = {ITEM}"), swept.where(f"kind = {GAP}")
    met = swept.where("bin is not null").select("key", "size", "bin", F.col("used").alias("offset"), F.col("nth").alias("gap"))
    if runs:
        table = F.broadcast(spark.createDataFrame(runs, "p int, first bigint, many bigint, q int, top bigint"))  # at most two rows a partition
        near = open_items.join(table, "p", "left").withColumn("hit", (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("many")))
        hit = near.where("hit").select("key", "size", "q", (F.col("top") - F.col("nth") + F.col("first")).alias("g"))
        far = cut(hit.join(open_gaps.select(F.col("p").alias("q"), F.col("nth").alias("g"), F.col("key").alias("bin"), F.col("used").alias("offset"), F.col("size").alias("gap")), ["q", "g"]).select("key", "size", "bin", "offset", "gap"))
        met = met.unionByName(far)
        open_items, open_gaps = open_items.join(far.select("key"), "key", "left_anti"), open_gaps.join(far.select(F.col("bin").alias("key")), "key", "left_anti")
    after = met.select("bin", (F.col("gap") - F.col("size")).alias("gap"), (F.col("offset") + F.col("size")).alias("used")).where("gap > 0")
    after = after.unionByName(open_gaps.select(F.col("key").alias("bin"), F.col("size").alias("gap"), "used"))
    return met.select("key", "size", "bin", "offset"), open_items.select("key", "size"), after, seen.get["n"] + sum(r[2] for r in runs)


def _filled(items: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``(key, bin, offset)`` of each ``(key, size)``, and the number of containers.

    Containers are opened as many as the remaining items need at least, with the largest of them in; then rounds of
    ``_matched`` fill them until nothing more fits, and so on.
    """
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    bins = 0
    fitting = 0
    while True:
        if not fitting:
            left = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            if not left:
                break
            need = -(-left // capacity)
            ranked = cut(numbered(items, [-F.col("size"), F.col("key")], F.lit(1).cast("bigint"), "turn"))
            seeds = ranked.where(F.col("turn") < need).select("key", "size", (F.col("turn") + bins).alias("bin"))
            placed.append(seeds.select("key", "bin", F.lit(0).cast("bigint").alias("offset")))
            opened = seeds.select("bin", (F.lit(capacity).cast("bigint") - F.col("size")).alias("gap"), F.col("size").alias("used")).where("gap > 0")
            gaps = opened if gaps is None else gaps.unionByName(opened)
            items = ranked.where(F.col("turn") >= need).select("key", "size")
            bins += need if need <= (n := ranked.count()) else n
        met, items, gaps, fitting = _matched(items, gaps)
        placed.append(met.select("key", "bin", "offset"))
    out = placed[0].where("false") if placed else items.select("key", F.col("key").alias("bin"), F.col("key").alias("offset"))
    for p in placed:
        out = out.unionByName(p)
    return out, bins


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``(id, piece_no, start_token, size, container, offset)``: every item in a container of ``capacity``, at ``offset``.

    Items larger than the capacity alone are divided, into full containers and a rest that is packed like any item; all
    others keep ``piece_no`` 0 and ``start_token`` 0. Containers are numbered from 0, the full ones of divided items last. Items
    of size 0 take no room and are dealt round the containers by a hash of the id (container 0 if there is none).

    Items and gaps stay distributed. The driver holds a few counts a partition and the totals of a round; the rounds are
    about as many as the items of one container.

    NULL sizes count as 0, negative ones are refused by ``assert_true``; repeated ids are packed one by one; other
    columns are not read; an empty table gives an empty result. The result is the same for any partitioning if ids are unique.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    size = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    sized = cut(docs.select(F.col(id_col).alias("_id"), size.alias("whole")))  # sizes may be costly expressions: computed once
    sized = sized.withColumn("_ok", F.expr("assert_true(whole >= 0)"))
    full = F.floor(F.col("whole") / capacity)
    full = F.when((F.col("whole") > 0) & (F.col("whole") % capacity == 0), full - 1).otherwise(full)
    parts = sized.where(F.col("_ok").isNull()).select("_id", "whole", full.alias("full"))
    rest = parts.select("_id", F.col("full").cast("int").alias("piece_no"), (F.col("full") * capacity).alias("start_token"), (F.col("whole") - F.col("full") * capacity).alias("size"))
    items = cut(numbered(rest.where("size > 0"), [-F.col("size"), F.col("_id"), F.col("piece_no")], F.lit(1).cast("bigint"), "key"))
    placed, bins = _filled(items.select("key", "size"), capacity)
    packed = items.join(placed, "key").select("_id", "piece_no", "start_token", "size", F.col("bin").alias("container"), "offset")
    empty = rest.where("size = 0").select("_id", "piece_no", "start_token", "size", F.pmod(F.xxhash64("_id"), F.lit(max(1, bins))).alias("container"), F.lit(0).cast("bigint").alias("offset"))
    divided = numbered(parts.where("full > 0").select("_id", "full", "whole"), [F.col("_id"), F.col("whole")], F.col("full"), "first")
    fulls = divided.select("_id", "first", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece_no")).select(
        "_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("size"),
        (F.lit(bins) + F.col("first") + F.col("piece_no")).alias("container"), F.lit(0).cast("bigint").alias("offset"),
    )
    out = packed.unionByName(empty).unionByName(fulls)
    return out.select(F.col("_id").cast(kind).alias(id_col), "piece_no", "start_token", "size", F.col("container").cast("bigint").alias("container"), "offset")
