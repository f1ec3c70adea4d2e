"""Best representative of each duplicate group: token-level consensus by progressive alignment and weighted votes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, ship
from .components import components

_TOKEN = re.compile(r"\w+|[^\w\s]")
GAP = ""


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value.casefold())


def align(columns: list[dict], other: list[dict]) -> list[dict]:
    """Two profiles merged into one by global alignment.

    A profile is a list of columns, each a map from token to weight, with the weight of rows that have no token there
    under ``GAP``. Columns that share a token score by the shared weight's share; a gap costs half a mismatch.
    """
    n, m = len(columns), len(other)
    if not n or not m:
        whole = sum(next(iter(columns or other), {}).values()) or 0.0
        return columns or other if whole else columns + other
    left, right = sum(columns[0].values()), sum(other[0].values())

    def same(a: dict, b: dict) -> float:
        return sum(min(w / left, b[t] / right) for t, w in a.items() if t and t in b)

    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    move = [[2] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0], move[i][0] = score[i - 1][0] - 0.5, 1
    for j in range(1, m + 1):
        score[0][j] = score[0][j - 1] - 0.5
        for i in range(1, n + 1):
            a = score[i - 1][j - 1] + 2 * same(columns[i - 1], other[j - 1]) - 0.75
            b, c = score[i - 1][j] - 0.5, score[i][j - 1] - 0.5
            score[i][j], move[i][j] = (a, 0) if a >= b and a >= c else (b, 1) if b >= c else (c, 2)
    out, i, j = [], n, m
    while i or j:
        kind = move[i][j] if i and j else 1 if i else 2
        a = columns[i - 1] if kind != 2 else {GAP: left}
        b = other[j - 1] if kind != 1 else {GAP: right}
        merged = dict(a)
        for t, w in b.items():
            merged[t] = merged.get(t, 0.0) + w
        out.append(merged)
        i, j = i - (kind != 2), j - (kind != 1)
    return out[::-1]


def consensus(columns: list[dict]) -> list[str]:
    """The heaviest token of each column (ties: the gap last, then the smaller token), gaps left out."""
    best = (max(c.items(), key=lambda x: (x[1], x[0] != GAP, [-ord(ch) for ch in x[0]]))[0] for c in columns)
    return [t for t in best if t]


def distance(a: list[str], b: list[str]) -> float:
    """Edit distance over tokens, where replacing a token costs the share of its characters that differ."""
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 1.0 if x[:1] != y[:1] else 0.8
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + swap)
    return row[-1]


def _fold(profiles: list[list[dict]]) -> list[dict]:
    out = profiles[0]
    for p in profiles[1:]:
        out = align(out, p)
    return out


def consensus_values(values: DataFrame, keys: list[str], block: int = 48) -> DataFrame:
    """For each group the existing value closest to the group's consensus.

    ``values`` has the ``keys``, ``value``, ``weight`` (positive) and ``rank`` (any sortable column, smaller is better),
    one row per distinct value of a group. The result has the keys, ``value`` and ``rank``.

    Values are aligned progressively from the heaviest on, each column votes by weight, and the value with the smallest
    token distance to the voted tokens survives; ties go to the heavier, then to the better rank. A group with more than
    ``block`` values is dealt by hash into blocks whose profiles are merged in further rounds of ``block`` each, so no task
    ever holds a whole group's values; a profile holds counts of tokens and not rows.

    Groups with one value skip Python. NULL values must not occur; equal values must have been summed before.
    """
    ship(values.sparkSession)
    spark_keys = [F.col(k) for k in keys]
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    marked = cut(values.join(sizes, keys))
    single = marked.where("_n = 1").select(*keys, "value", "rank")
    several = marked.where("_n > 1")
    level = several.withColumn("_block", F.pmod(F.xxhash64("value"), F.ceil(F.col("_n") / block)))
    pack = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("rank").cast("string").alias("r"), "value")))

    @F.pandas_udf("string")
    def first_profile(rows: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_fold([[{t: -r["w"]} for t in tokens(r["value"])] or [{GAP: -r["w"]}] for r in group])) for group in rows])

    @F.pandas_udf("string")
    def merged_profile(rows: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_fold([json.loads(p) for p in group])) for group in rows])

    profiles = cut(level.groupBy(*keys, "_block", "_n").agg(pack.alias("rows")).select(*keys, "_block", "_n", first_profile("rows").alias("profile")))
    blocks = -(-(profiles.agg(F.max("_n")).first()[0] or 0) // block)
    while blocks > 1:
        blocks = -(-blocks // block)
        regrouped = profiles.withColumn("_block", F.floor(F.col("_block") / block)).groupBy(*keys, "_block", "_n")
        profiles = cut(regrouped.agg(F.sort_array(F.collect_list("profile")).alias("rows")).select(*keys, "_block", "_n", merged_profile("rows").alias("profile")), replaces=profiles)

    @F.pandas_udf("string")
    def vote(profile: pd.Series) -> pd.Series:
        return profile.map(lambda p: json.dumps(consensus(json.loads(p))))

    @F.pandas_udf("double")
    def away(value: pd.Series, agreed: pd.Series) -> pd.Series:
        return pd.Series([distance(tokens(v), json.loads(a)) for v, a in zip(value, agreed)])

    agreed = profiles.select(*keys, vote("profile").alias("agreed"))
    best = F.min_by(F.struct("value", "rank"), F.struct("away", (-F.col("weight")).alias("w"), "rank", "value"))
    closest = several.join(agreed, keys).withColumn("away", away("value", "agreed")).groupBy(*spark_keys).agg(best.alias("best"))
    return single.unionByName(closest.select(*keys, "best.value", "best.rank"))


def survivors(rows: DataFrame, keys: list[str], trust: Column, recency: Column, id_col: str = "id", priority: bool = True) -> DataFrame:
    """The surviving value of each group, as ``(keys, value, row_id)``; ``row_id`` is the smallest id with exactly that value.

    ``rows`` has the keys, ``value`` and the id, one row per usable value. Rows are ordered by ``trust`` (smaller first),
    then by latest ``recency``, then by id. A value's weight is the number of its rows; with ``priority`` the first row's
    value also gets as much as all rows together, so that it outvotes the rest wherever it has a token and where it has
    none: the consensus then is that value. Without it trusted sources count more (``5 - trust``, at least 1).

    Equal values are summed before anything is shuffled by group, so a group of a third of all rows with few values is small.
    NULL values are ignored; a NULL recency is the earliest.
    """
    by = F.struct(trust.alias("trust"), (-F.coalesce(recency.cast("double"), F.lit(-1e18))).alias("late"), F.col(id_col).alias("id"))
    weight = F.lit(1.0) if priority else F.greatest(F.lit(5.0) - trust, F.lit(1.0))
    known = rows.where(F.col("value").isNotNull()).select(*keys, "value", by.alias("rank"), weight.alias("w"), F.col(id_col).alias("row_id"))
    values = cut(known.groupBy(*keys, "value").agg(F.sum("w").alias("w"), F.min("rank").alias("rank"), F.min("row_id").alias("row_id")))
    groups = values.groupBy(*keys).agg(F.sum("w").alias("all"), F.min("rank").alias("first"))
    dominant = F.col("w") + (F.when(F.col("rank") == F.col("first"), F.col("all")).otherwise(0.0) if priority else F.lit(0.0))
    weighted = values.join(groups, keys).select(*keys, "value", dominant.alias("weight"), F.struct("rank", "row_id").alias("rank"))
    return consensus_values(weighted, keys).select(*keys, "value", F.col("rank.row_id").alias("row_id"))


def duplicate_groups(rows: DataFrame, keys: list[Column], id_col: str = "id") -> DataFrame:
    """``(id, group_id)`` for rows joined, directly or through others, by an equal non-NULL key; rows alone have no row.

    Every key links its rows to the smallest id that has it: one link a row and key, never all pairs.
    """
    held = rows.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(f"{i}|"), k) for i, k in enumerate(keys)])))).alias("key"))
    held = cut(held.where("id is not null").withColumn("key", F.xxhash64("key")))
    heads = held.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    linked = held.join(heads, "key").select(F.col("head").alias("left"), F.col("id").alias("right"))
    return components(linked).select(F.col("node").alias("id"), F.col("root").alias("group_id"))
