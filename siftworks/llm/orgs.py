"""Organizations as comparable entries: one per unit and spelling, with whatever else tells them apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unmarked
from ..tables import cut
from . import names
from .orgnames import parts
from .survivors import duplicate_groups

FIELDS = ("country", "day", "city", "street", "postcode", "phone")


def source_groups(orgs: DataFrame) -> DataFrame:
    """``(id, group_id)`` of rows that share a source record or an LEI."""
    key = F.when((F.col("source") != "") & (F.col("source_id") != ""), F.concat_ws("|", "source", "source_id"))
    return duplicate_groups(orgs, [key, names.lei(F.col("source"), F.col("source_id"), F.col("record"))])


def compact(value: Column) -> Column:
    """Letters and digits only, in lower case and without marks; NULL if none is left."""
    bare = F.regexp_replace(unmarked(value), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)


def own_entries(orgs: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per organizations row: ``id, source, source_id, name, lei`` and its parts and fields, in comparable form, nothing filled in.

    Stand-ins and identifiers have no words. ``countries`` has ``value`` and ``code`` of the entered regions.
    """
    entry = lambda k: F.element_at("record", F.lit(k))
    usable = names.usable_name(F.col("name"), F.col("source_id"))
    codes = countries.select(F.col("value").alias("region"), F.col("code").alias("country"))
    base = orgs.select(
        "id", "name", "source", "source_id", "region",
        F.when(names.usable_date(F.col("from_date")), F.col("from_date")).alias("day"),
        compact(entry("city")).alias("city"), compact(entry("street")).alias("street"), compact(entry("postcode")).alias("postcode"),
        F.expr("nullif(right(regexp_replace(element_at(record, 'phone'), '[^0-9]', ''), 10), '')").alias("phone"),
        names.lei(F.col("source"), F.col("source_id"), F.col("record")).alias("lei"),
        parts(F.when(usable, F.col("name")).otherwise(F.lit(""))).alias("p"),
    ).select("*", "p.*").drop("p")
    base = base.join(codes, "region", "left").drop("region").withColumn("country", F.coalesce("country", F.when(F.length("mark") == 2, F.col("mark"))))
    return cut(base)


def filled_entries(orgs: DataFrame, own: DataFrame, kept: tuple[str, ...] = ("source", "source_id", "name", "lei"), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``own`` with its ``unit``, the smallest id of the rows that share a source record or an LEI with it.

    A field that a row lacks is taken from its unit (the smallest value, so that it doesn't depend on order). Of the columns
    that nothing is compared by only those ``kept`` are moved. The files of ``own`` are removed.
    """
    groups = cut(source_groups(orgs))
    shared = own.select("id", *fields).join(groups, "id").groupBy("group_id").agg(*[F.min(c).alias(f"u_{c}") for c in fields])
    known = groups.join(shared, "group_id")
    filled = own.join(known, "id", "left")
    return cut(filled.select("id", F.coalesce("group_id", "id").alias("unit"), *kept, "words", "sounds", "business", "fund", "legal", "mark", *[F.coalesce(c, f"u_{c}").alias(c) for c in fields]), replaces=own)


def entries(orgs: DataFrame, countries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``own_entries`` by ``id`` and ``unit`` with their parts and ``fields``, filled in from their units."""
    return filled_entries(orgs, own_entries(orgs, countries), (), fields)


def edits(x: Column, y: Column, plain: Column | None = None) -> Column:
    """Edit distance, from the ``plain`` one if it is known; two letters that changed places are one edit."""
    plain = F.levenshtein(x, y) if plain is None else plain
    swapped = (plain == 2) & (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    return F.when(swapped, 1).otherwise(plain)


def near(x: Column, y: Column) -> Column:
    """Two words that may be one: equal but for an edit in four letters, or one the beginning of the other."""
    shorter = F.least(F.length(x), F.length(y))
    return (edits(x, y) <= F.greatest(F.floor(F.greatest(F.length(x), F.length(y)) / 4), F.lit(1))) | ((shorter >= 4) & (F.startswith(x, y) | F.startswith(y, x)))


def same_words(a: Column, b: Column) -> Column:
    """Every word of the shorter list has a near word in the other one."""
    within = lambda s, o: F.forall(s, lambda x: F.exists(o, lambda y: near(x, y)))
    return F.when(F.size(a) <= F.size(b), within(a, b)).otherwise(within(b, a))


def joined(a: Column, b: Column) -> Column:
    """One list is the other written as one word, in any order of two."""
    def run(ws: Column, o: Column) -> Column:
        whole = F.array_join(ws, "")
        turned = F.array_join(F.reverse(ws), "")
        return (F.size(o) == 1) & (F.size(ws) == 2) & ((F.levenshtein(whole, F.get(o, F.lit(0))) <= 2) | (F.levenshtein(turned, F.get(o, F.lit(0))) <= 2))

    return run(a, b) | run(b, a)


def years_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(F.to_date(a), F.to_date(b))) / 365.25


def keys(e: DataFrame, rules: list[tuple[str, list[Column]]]) -> DataFrame:
    """``(rule, key)`` rows of each entry: a key is the hash of the rule's columns, if none of them is NULL; an array column gives a key for each of its words."""
    def made(k: int, cols: list[Column]) -> Column:
        known = reduce(lambda x, y: x & y, [c.isNotNull() for c in cols])
        return F.when(known, F.struct(F.lit(k).alias("rule"), F.xxhash64(F.lit(k), *cols[1:]).alias("rest"), cols[0].alias("ws")))

    # exploded twice, by rule and by word, which is compiled; functions of arrays are not
    each = e.withColumn("k", F.explode(F.array(*[made(k, cols) for k, (_, cols) in enumerate(rules)]))).where("k is not null")
    each = each.select("*", "k.*").drop("k").withColumn("w", F.explode("ws")).where("w is not null")
    return each.withColumn("key", F.xxhash64("rest", "w")).drop("rest", "ws", "w")
