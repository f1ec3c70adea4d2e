"""Matching organizations across sources without keys: a deterministic cascade of exact joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut
from .canonical import canonical_countries
from .orgs import edits, filled_entries, joined, keys, own_entries, same_words, years_apart


def _ends(word: Column, n: int) -> Column:
    """The beginning and the end of a word, ``n`` letters each: a slip leaves one of them."""
    return F.array(F.concat(F.lit("<"), F.substring(word, 1, n)), F.concat(F.lit(">"), F.substring(word, -n, n)))


def _rules() -> list[tuple[str, list[Column]]]:
    """From the strongest combination of attributes to the weakest. The first column of each is an array.

    Combinations that many organizations of one place share also take a piece of a word, the beginning or end of another
    one or of either: a pair that ``agree`` accepts has one in common, and a frequent combination falls into small keys.
    """
    c = F.col
    whole = F.when(F.size("sounds") >= 2, F.array(F.array_join("sounds", " ")))
    each = F.when(F.size("sounds") > 0, c("sounds"))
    run = F.when(F.size("words") == 2, F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), ""))).when((F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 9), c("words"))
    business = F.when(c("business") != "", c("business"))
    fund = c("fund").cast("string")
    others = lambda w: F.filter("sounds", lambda v: v != w)
    beside = F.flatten(F.transform("sounds", lambda w: F.transform(F.flatten(F.transform(others(w), lambda v: _ends(v, 2))), lambda e: F.concat_ws("|", w, e))))
    pieces = F.flatten(F.transform("sounds", lambda w: _ends(w, 3)))
    alone = F.when(F.size("sounds") == 1, c("sounds"))
    return [
        ("name, country, day", [whole, business, fund, c("country"), c("day")]),
        ("name, country, city", [whole, business, fund, c("country"), c("city")]),
        ("name, city, day", [whole, fund, c("city"), c("day")]),
        ("name, country", [whole, business, fund, c("country")]),
        ("word, country, day", [each, fund, c("country"), c("day")]),
        ("word, country, city", [each, business, fund, c("country"), c("city")]),
        ("word, city, day", [each, fund, c("city"), c("day")]),
        ("name without business, country", [whole, fund, c("country")]),
        ("name run together, country", [run, business, fund, c("country")]),
        ("word and part of another, country", [beside, business, fund, c("country")]),
        ("word and part of another, city", [beside, business, fund, c("city")]),
        ("single word, country", [alone, business, fund, c("country")]),
        ("name anywhere", [whole, business, fund]),
        ("city, day", [F.array("city"), c("day")]),
        ("phone, city", [F.array("phone"), c("city")]),
        ("street, city", [F.array("street"), c("city")]),
        ("phone, street", [F.array("phone"), c("street")]),
        ("parts of words, city, business, country", [pieces, c("city"), business, fund, c("country")]),
        ("parts of words, day, business, country", [pieces, c("day"), business, fund, c("country")]),
    ]


def agree(a: str = "a", b: str = "b") -> Column:
    """The facts of two entries don't contradict each other, and more than a name speaks for them where the name alone is weak."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    both = lambda f: x(f).isNotNull() & y(f).isNotNull()
    same = lambda f: F.coalesce(x(f) == y(f), F.lit(False))
    named = (F.size(x("sounds")) > 0) & (F.size(y("sounds")) > 0)
    city = both("city") & (edits(x("city"), y("city")) <= F.greatest(F.length(x("city")) / 4, F.lit(1)))
    other_city = both("city") & ~city & ~same("phone")
    apart = years_apart(x("day"), y("day"))
    day = both("day") & (apart <= 2.2)
    other_day = both("day") & (apart > 2.2)
    country = same("country")
    other_country = both("country") & ~country
    business = (x("business") == y("business")) | (x("business") == "") | (y("business") == "")
    full = (F.size(x("sounds")) >= 2) & (F.size(y("sounds")) >= 2)
    words = same_words(x("sounds"), y("sounds")) | joined(x("words"), y("words"))
    support = F.when(city, 1).otherwise(0) + F.when(day, 1).otherwise(0) + F.when(same("phone"), 1).otherwise(0) + F.when(same("street") & city, 1).otherwise(0)
    against = F.when(other_city, 1).otherwise(0) + F.when(other_day, 1).otherwise(0)
    by_name = named & business & (x("fund") == y("fund")) & ~other_country & words & (
        (full & (against == 0) & (country | (support >= 1))) | (full & (x("business") == y("business")) & (support > against) & country)
        | (~full & (support >= 1) & (against == 0) & (country | (support >= 2)))
    )
    by_facts = ~named & ~other_country & (against == 0) & ((city & day & country) | (city & same("phone")) | (city & same("street")) | (same("phone") & same("street")))
    return by_name | by_facts


#: The last rule: equal partners. Its key is the unit in a third source that both were matched with.
PARTNER = "same partner"
FACTS = ("sounds", "words", "business", "fund", "country", "day", "city", "phone", "street")


def _spelled(whole: DataFrame, *more: str) -> DataFrame:
    """Distinct entries of a unit and source, numbered."""
    return cut(whole.groupBy("unit", "source", *FACTS, *more).agg(F.count(F.lit(1)).alias("rows")).drop("rows").withColumn("nth", F.monotonically_increasing_id()))


def _keyed(spelled: DataFrame, rules: list[tuple[str, list[Column]]]) -> DataFrame:
    """``(rule, key, nth, unit, source, sources)``: the keys that two sources share, with the hashes of those sources.

    One file per rule, so that a pass reads its own keys only.
    """
    keyed = cut(keys(spelled.select("unit", F.hash("source").alias("source"), "nth", *FACTS), rules).select("rule", "key", "nth", "unit", "source").distinct())
    shared = keyed.groupBy("rule", "key").agg(F.collect_set("source").alias("sources")).where("size(sources) > 1")  # a set of the table's few sources
    return cut(keyed.join(shared, ["rule", "key"]).repartition("rule", "key"), replaces=keyed, by="rule")


def _compared(met: DataFrame, spelled: DataFrame, *more: str) -> DataFrame:
    """The pairs ``(n1, n2)`` with their facts ``a`` and ``b``, those that contradict each other left out."""
    facts = F.struct(*FACTS, *more)
    return met.join(spelled.select(F.col("nth").alias("n1"), facts.alias("a")), "n1").join(spelled.select(F.col("nth").alias("n2"), facts.alias("b")), "n2").where(agree())


def rule_precision(spark: SparkSession, own: DataFrame) -> DataFrame:
    """``(rule, rule_name, right, labelled, confidence)`` of each rule on labelled pairs, the LEIs hidden; ``own`` is from ``own_entries``.

    Labelled are pairs of rows of different sources that both have an LEI: right if it is the same. Nothing of the labels
    reaches the rules: rows are not joined by LEI and nothing is filled in from other rows. A pair counts for the first rule
    that finds it. Confidence is smoothed by one pair of either kind.
    """
    rules = _rules()
    spelled = _spelled(own.where("lei is not null").withColumn("unit", F.col("id")), "lei")
    keyed = _keyed(spelled, rules)
    left, right = keyed.select("rule", "key", F.col("nth").alias("n1"), F.col("source").alias("s1")), keyed.select("rule", "key", F.col("nth").alias("n2"), F.col("source").alias("s2"))
    met = left.join(right, ["rule", "key"]).where("n1 < n2 and s1 <> s2").groupBy("n1", "n2").agg(F.min("rule").alias("rule"))
    judged = cut(_compared(met, spelled, "lei").select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), "rule", "a.lei", F.col("b.lei").alias("other")))
    third = _partners(judged.select("u1", "u2").union(judged.select("u2", "u1")), spelled.withColumn("unit", F.col("nth")))
    tag = spelled.select("nth", "lei", "source")
    third = third.join(tag.toDF("u1", "lei", "s1"), "u1").join(tag.toDF("u2", "other", "s2"), "u2").where("s1 <> s2").select("u1", "u2", F.lit(len(rules)).alias("rule"), "lei", "other")
    judged = judged.unionByName(third).groupBy("rule").agg(F.count_if(F.col("lei") == F.col("other")).alias("right"), F.count(F.lit(1)).alias("labelled"))
    titles = spark.createDataFrame([*((k, n) for k, (n, _) in enumerate(rules)), (len(rules), PARTNER)], "rule int, rule_name string")
    both = F.coalesce("right", F.lit(0)), F.coalesce("labelled", F.lit(0))
    return cut(titles.join(judged, "rule", "left").select("rule", "rule_name", both[0].alias("right"), both[1].alias("labelled"), ((both[0] + 1) / (both[1] + 2)).alias("confidence")))


def match_sources(spark: SparkSession, orgs: DataFrame) -> DataFrame:
    """``(unit_a, unit_b, rule, confidence)``: pairs of units that are one legal entity, with at least two sources between them.

    A unit is the rows joined by a source record or an LEI. The rules of ``_rules`` are joined one after another, from the
    strongest on, each on the equality of its attributes; a pair must also pass ``agree``. A unit that found its partner
    in another source is resolved for that source. The last rule joins units on their partner: two that were matched with
    one unit of a third source, if nothing known of them differs (``_partners``). Before each pass the units that are resolved for all sources
    that share their key leave it by an anti-join, and an open unit meets entries of the sources only that it is open for.

    ``confidence`` is the rule's precision on labelled pairs (``rule_precision``).

    Keys are 64-bit hashes; equal spellings of a unit meet once. NULL or blank attributes make no key, so a missing value never
    matches a missing one. Unusable names have no words and can match by facts only. Empty tables give no pairs.
    """
    countries = cut(canonical_countries(spark, orgs.select(F.col("region").alias("value"))).where("code is not null").select("value", "code"))
    own = own_entries(orgs, countries)
    precision = rule_precision(spark, own)
    spelled = _spelled(filled_entries(orgs, own))
    rules = _rules()
    keyed = _keyed(spelled, rules)
    found: DataFrame | None = None
    for k in range(len(rules)):
        own = keyed.where(F.col("rule") == k)
        open_ = own.withColumn("open", F.array_except("sources", F.array("source")))
        if found is not None:  # the sources that a unit is resolved for
            have = found.select(F.col("u1").alias("unit"), "s2").union(found.select("u2", "s1")).groupBy("unit").agg(F.collect_set("s2").alias("have"))
            open_ = open_.join(have, "unit", "left").withColumn("open", F.array_except("open", F.coalesce("have", F.array().cast("array<int>")))).where("size(open) > 0")
        left = open_.select("key", "open", F.col("nth").alias("n1"), F.col("unit").alias("u1"), F.col("source").alias("s1"))
        right = own.select("key", F.col("nth").alias("n2"), F.col("unit").alias("u2"), F.col("source").alias("s2"))
        met = left.join(right, "key").where(F.array_contains("open", F.col("s2")) & (F.col("n1") != F.col("n2"))).select("n1", "n2", "u1", "u2", "s1", "s2")
        fine = _compared(met, spelled).select("u1", "u2", "s1", "s2", F.lit(k).alias("rule"))
        found = cut((fine if found is None else found.unionByName(fine)).hint("rebalance"), replaces=found)  # few files, whatever the passes
    pairs = found.where("u1 <> u2").groupBy(F.least("u1", "u2").alias("u1"), F.greatest("u1", "u2").alias("u2")).agg(F.min("rule").alias("rule"))
    pairs = cut(pairs, replaces=found)
    third = _partners(pairs.select("u1", "u2").union(pairs.select("u2", "u1")), spelled).withColumn("rule", F.lit(len(rules)))
    direct = pairs.unionByName(third).groupBy(F.col("u1").alias("unit_a"), F.col("u2").alias("unit_b")).agg(F.min("rule").alias("rule"))
    return direct.join(F.broadcast(precision), "rule").select("unit_a", "unit_b", F.col("rule_name").alias("rule"), F.round("confidence", 4).alias("confidence"))  # precision has a row a rule


def _partners(matched: DataFrame, spelled: DataFrame) -> DataFrame:
    """``(u1, u2)``, u1 < u2, of the units joined on an equal partner; ``matched`` has every pair in both directions. Fund, business and country must not differ."""
    facts = ("fund", "business", "country")
    face = spelled.where(F.size("sounds") > 0).groupBy("unit").agg(F.max("fund").alias("fund"), F.min(F.when(F.col("business") != "", F.col("business"))).alias("business"), F.min("country").alias("country"))
    held = cut(matched.join(face.withColumnRenamed("unit", "u1"), "u1", "left").select(F.col("u2").alias("via"), F.col("u1").alias("unit"), *facts))
    a, b = held.alias("a"), held.alias("b")
    fits = (F.col("a.via") == F.col("b.via")) & (F.col("a.unit") < F.col("b.unit"))
    for f in facts:
        fits = fits & F.coalesce(F.col(f"a.{f}") == F.col(f"b.{f}"), F.lit(True))
    return a.join(b, fits).select(F.col("a.unit").alias("u1"), F.col("b.unit").alias("u2")).distinct()


def row_pairs(orgs: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows behind unit pairs: ``(id_a, id_b, rule, confidence)`` with id_a < id_b and different sources."""
    member = orgs.select("id", "source").join(groups, "id", "left").select("id", "source", F.coalesce("group_id", "id").alias("unit"))
    a = member.select(F.col("unit").alias("unit_a"), F.col("id").alias("i"), F.col("source").alias("si"))
    b = member.select(F.col("unit").alias("unit_b"), F.col("id").alias("j"), F.col("source").alias("sj"))
    rows = pairs.join(a, "unit_a").join(b, "unit_b").where("si <> sj")
    return rows.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "rule", "confidence")
