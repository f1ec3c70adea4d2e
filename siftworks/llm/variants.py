"""Variant spellings of names: noisy-channel attribution to frequent spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import cut, release
from . import names, orgnames, personnames
from .canonical import canonical_countries, canonical_roles
from .cascade import agree
from .components import components
from .orgs import compact, edits, entries, joined, keys

# Natural-log likelihoods of the channel, for one word.
SAME, RESPELT, SLIP, CUT, INITIAL, LEFT_OUT, ELSE = 0.0, -0.7, -3.0, -3.0, -2.0, -2.5, -12.0


def word_cost(x: Column, y: Column) -> Column:
    """Log-likelihood that one writes the word x for y: the same, an initial, a slip or two of the keys, cut off, another word."""
    longest, shortest = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    allowed = F.greatest(F.floor(longest / 4), F.lit(1))
    other = F.when((shortest >= 4) & (F.startswith(x, y) | F.startswith(y, x)), CUT).otherwise(ELSE)

    def slipped(plain: Column) -> Column:
        slips = edits(x, y, plain)
        return F.when(slips <= allowed, slips * SLIP).otherwise(other)

    # the distance is bound to a name: functions of arrays work an expression out as often as it stands in them
    return (
        F.when(x == y, SAME)
        .when(shortest == 1, F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), INITIAL).otherwise(ELSE))
        .when(longest - shortest > allowed, other)
        .otherwise(F.get(F.transform(F.array(F.levenshtein(x, y)), slipped), F.lit(0)))
    )


def name_likelihood(a: Column, b: Column) -> Column:
    """Log-likelihood that two lists of words are writings of one name.

    Each word of the shorter list is written for its likeliest word of the other, in any order; words of the longer list
    beyond that are left out.
    """
    def one_way(s: Column, o: Column) -> Column:
        likeliest = lambda x: F.coalesce(F.array_max(F.transform(o, lambda y: word_cost(x, y))), F.lit(ELSE))
        best = F.transform(s, lambda x: F.when(F.array_contains(o, x), SAME).otherwise(likeliest(x)))  # nothing is likelier than the same word
        return F.aggregate(best, F.lit(0.0), lambda t, v: t + v) + (F.size(o) - F.size(s)) * LEFT_OUT

    return F.when(F.size(a) <= F.size(b), one_way(a, b)).otherwise(one_way(b, a))


def attribute(scored: DataFrame, sure: float, above: float | None = None) -> DataFrame:
    """``(variant, canonical)``: of the scored candidates ``(variant, candidate, posterior)`` the likeliest one, ties to the smaller candidate.

    A variant that is ``sure`` of several candidates belongs to each, which makes them one: their own forms had too little in common.
    Candidates that are not ``above`` a posterior don't count; they are left out after it is written, else it is worked out twice.
    """
    scored = cut(scored)
    if above is not None:
        scored = scored.where(F.col("posterior") > above)
    best = scored.groupBy("variant").agg(F.max_by("candidate", F.struct("posterior", -F.col("candidate"))).alias("canonical"))
    return best.unionByName(scored.where(F.col("posterior") >= sure).select("variant", F.col("candidate").alias("canonical"))).distinct()


def ranked_pairs(keyed: DataFrame, fits: Column) -> DataFrame:
    """``(variant, candidate)`` for entries that share a key, the better-ranked one as candidate; each pair once.

    ``keyed`` has ``key``, ``nth``, ``rank`` (the larger the better; of equals the smaller ``nth``) and what ``fits``, a
    condition on the sides ``l`` and ``r``, needs: pairs it rules out are dropped before anything is shuffled again. Both
    sides are read from one shuffle, so the keys are made once and not written besides; it leaves the disk with this step.
    """
    left, right = keyed.alias("l"), keyed.alias("r")
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.nth") < F.col("r.nth")) & fits)
    ahead = F.col("l.rank") >= F.col("r.rank")
    pairs = met.select(F.when(ahead, F.col("r.nth")).otherwise(F.col("l.nth")).alias("variant"), F.when(ahead, F.col("l.nth")).otherwise(F.col("r.nth")).alias("candidate"))
    release(keyed.sparkSession)
    pairs = cut(pairs.distinct())
    release(keyed.sparkSession)
    return pairs


def entry_heads(base: DataFrame) -> DataFrame:
    """``(same, nth, rows, uses)``: of the rows with an equal hash ``same`` the smallest ``id`` and how many they are; how many rows have their ``text``.

    ``base`` is read for ``id``, ``same`` and ``text`` alone, so that its wide rows are shuffled once, to what is found here.
    """
    first = base.groupBy("same").agg(F.min("id").alias("nth"), F.count(F.lit(1)).alias("rows"), F.min("text").alias("text"))
    uses = base.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
    return cut(first.join(uses, "text").select("same", "nth", "rows", "uses"))


def with_sides(pairs: DataFrame, held: DataFrame, side: Column) -> DataFrame:
    """``pairs`` of ``variant`` and ``candidate`` with the ``side`` of either's row in ``held``, by ``nth``, as ``a`` and ``b``.

    Both are read from one shuffle: in an array, no side is stripped of what only the other one is asked for.
    """
    held = held.select("nth", F.array(side).alias("of"))
    met = pairs.join(held.alias("l"), F.col("variant") == F.col("l.nth")).join(held.alias("r"), F.col("candidate") == F.col("r.nth"))
    return met.select("variant", "candidate", F.element_at("l.of", 1).alias("a"), F.element_at("r.of", 1).alias("b"))


def left_out(df: DataFrame, beside: Column, nth: str) -> DataFrame:
    """``(key, nth)``: hashes of each of the ``sounds``, and of it without each of its letters, with the number ``beside``; repeats are possible."""
    words = df.select(nth, beside.alias("beside"), F.explode("sounds").alias("w"))
    cuts = words.select("*", F.explode(F.sequence(F.lit(0), F.when(F.length("w") >= 3, F.length("w")).otherwise(0))).alias("i"))
    less = F.when(F.col("i") == 0, F.col("w")).otherwise(F.concat(F.expr("substring(w, 1, i - 1)"), F.expr("substring(w, i + 1, length(w))")))
    return cuts.select(F.xxhash64("beside", less).alias("key"), nth)


# --- organizations -----------------------------------------------------------------------------------------------


def org_clusters(orgs: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spelled)``: ``id``, ``unit`` and ``cluster`` of organizations rows and whether it has other units (``linked``), and the distinct spellings with parts and cluster.

    A spelling is a unit's (rows of one source record or LEI) way to write its name. Spellings rank by how many rows use
    them, then by fullness; each is attached to the better-ranked spelling with the largest posterior: log of its
    frequency plus the likelihood of the slips, among those whose facts agree. Units of one cluster are one organization.
    """
    f = F.col
    facts = ["sounds", "words", "business", "fund", "country", "day", "city", "phone", "street"]
    text = F.xxhash64("sounds", "business", "fund")
    whole = entries(orgs, countries, tuple(facts[4:]))
    heads = entry_heads(whole.select("id", F.xxhash64("unit", *facts, "legal", "mark").alias("same"), text.alias("text")))
    spelled = cut(whole.select("id", "unit", *facts, "legal", "mark").join(heads.select(f("nth").alias("id"), "rows", "uses"), "id").withColumnRenamed("id", "nth"))
    business = F.when(f("business") != "", f("business"))
    each, name = F.when(F.size("sounds") > 0, f("sounds")), F.when(F.size("sounds") >= 2, F.array(F.array_join("sounds", " ")))
    # one word or two run together in either order: the letters, sorted
    letters = F.array_join(F.array_sort(F.split(F.array_join("words", ""), "")), "")
    run = F.when((F.size("words") == 2) | ((F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 9)), F.array(letters))
    fund = f("fund").cast("string")
    rules = [
        ("word, business, country", [each, business, fund, f("country")]), ("word, city", [each, fund, f("city")]), ("word, day", [each, fund, f("day")]),
        ("name, business", [name, business, fund]), ("name, country", [name, fund, f("country")]), ("run together", [run, business, fund]), ("city, day", [F.array("city"), f("day")]), ("phone, country", [F.array("phone"), f("country")]),
    ]
    rank = f("uses") * 16 + F.size("sounds") * 2 + F.when(f("business") != "", 1).otherwise(0)
    keyed = keys(spelled, rules).select("key", "nth", rank.alias("rank"), F.when(f("country").isNotNull(), F.hash("country")).alias("country"))
    apart = (f("l.country").isNull() | f("r.country").isNull() | (f("l.country") == f("r.country")))
    side = F.struct("unit", "uses", *facts)
    met = with_sides(ranked_pairs(keyed, apart), spelled, side)
    posterior = F.log(f("b.uses") + 1.0) + name_likelihood(f("a.sounds"), f("b.sounds"))
    scored = met.where((f("a.unit") != f("b.unit")) & agree()).select("variant", "candidate", posterior.alias("posterior"))
    units = spelled.select("nth", "unit")
    links = attribute(scored, -5.0).join(units.select(f("nth").alias("variant"), f("unit").alias("a")), "variant").join(units.select(f("nth").alias("canonical"), f("unit").alias("b")), "canonical")
    found = cut(components(links.select("a", "b"), "a", "b").select(f("node").alias("unit"), f("root").alias("cluster")))
    in_cluster = lambda df: df.join(found, "unit", "left").withColumn("linked", f("cluster").isNotNull()).withColumn("cluster", F.coalesce("cluster", "unit"))
    rows = cut(in_cluster(whole.select("id", "unit")), replaces=whole)
    return rows, cut(in_cluster(spelled.select("unit", "words", "sounds", "business", "fund", "legal", "country", "rows")).drop("linked"), replaces=spelled)


def org_pairs(orgs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(key_a, key_b)``: rows of one cluster and source with different source ids, units and names."""
    rows = rows.where("linked").select("id", "unit", "cluster").dropDuplicates(["id"]).join(orgs.select("id", "source", "source_id", "name"), "id")
    a = rows.select("cluster", "source", *[F.col(c).alias(f"{c}_a") for c in ("id", "unit", "source_id", "name")])
    b = rows.select("cluster", "source", *[F.col(c).alias(f"{c}_b") for c in ("id", "unit", "source_id", "name")])
    other = (F.col("id_a") < F.col("id_b")) & (F.col("unit_a") != F.col("unit_b")) & (F.col("source_id_a") != F.col("source_id_b")) & ~F.col("name_a").eqNullSafe(F.col("name_b"))
    return a.join(b, ["cluster", "source"]).where(other).select(F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))


def employer_pairs(people: DataFrame, orgs: DataFrame, rows: DataFrame, spelled: DataFrame) -> DataFrame:
    """``(key_a, key_b)``: organizations rows and people rows whose employer is written otherwise and not identified.

    Texts are deduplicated and taken apart; each is attached to the spelling of an organization with the largest posterior:
    log of the spelling's rows plus the likelihood of the slips, of the legal form and of a country mark. The line of
    business must be the same, the fund too. Texts without a likely enough spelling stay unlisted.
    """
    f = F.col
    open_ = people.where("known_for_org_id is null and trim(known_for_org) <> ''").select("id", f("known_for_org").alias("text"))
    exact = orgs.select(f("name").alias("text")).where("text is not null").distinct()
    open_ = cut(open_.join(exact, "text", "left_anti"))
    texts = cut(open_.select("text").distinct().withColumn("p", orgnames.parts(f("text"))).select("text", "p.*").where("size(sounds) > 0 and business <> ''").withColumn("nth", F.monotonically_increasing_id()))
    spellings = cut(
        spelled.where("size(sounds) > 0 and business <> ''").groupBy("words", "sounds", "business", "fund", "legal", "cluster").agg(F.sum("rows").alias("rows"), F.min("country").alias("country"))
        .withColumn("candidate", F.monotonically_increasing_id())
    )
    fund = f("fund").cast("string")
    two, one = F.size("words") == 2, (F.size("words") == 1) & (F.length(F.get("words", F.lit(0))) >= 8)
    ends = lambda w: F.array(F.concat(F.lit("<"), F.substring(w, 1, 4)), F.concat(F.lit(">"), F.substring(w, -4, 4)))
    run = F.when(two, F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), ""))).when(one, f("words"))
    parts_of_two, parts_of_one = F.when(two, F.flatten(F.transform("words", ends))), F.when(one, ends(F.get("words", F.lit(0))))
    # a word as it is and with each letter left out: two words a slip apart have one of them in common. Run together with a slip: the
    # beginning or end of the whole, which is that of one of two words
    rules = lambda x, y: [("run", [run, f("business"), fund]), ("two", [x, f("business"), fund]), ("one", [y, f("business"), fund])]
    made = lambda df, n, x, y: left_out(df, F.xxhash64("business", "fund"), n).union(keys(df.select(n, "words", "business", "fund"), rules(x, y)).select("key", n))
    left, right = made(texts, "nth", parts_of_two, parts_of_one), made(spellings, "candidate", parts_of_one, parts_of_two)
    release(people.sparkSession)
    met = cut(left.join(right, "key").select("nth", "candidate").distinct())
    release(people.sparkSession)
    met = met.join(texts.select("nth", F.struct("words", "sounds", "legal", "mark").alias("a")), "nth").join(spellings.select("candidate", "cluster", F.struct("words", "sounds", "legal", "country", "rows").alias("b")), "candidate")
    form = F.when((f("a.legal") == "") | (f("b.legal") == ""), -0.5).when(f("a.legal") == f("b.legal"), 0.0).otherwise(-3.0)
    mark = F.when(F.length("a.mark") != 2, 0.0).when(f("b.country").isNull(), -0.5).when(f("a.mark") == f("b.country"), 0.0).otherwise(-6.0)
    together = joined(f("a.words"), f("b.words"))
    spelt = F.greatest(name_likelihood(f("a.sounds"), f("b.sounds")), F.when(together, -2.0).otherwise(F.lit(-99.0)))
    enough = (F.least(F.size("a.sounds"), F.size("b.sounds")) >= 2) | together | ((F.size("a.sounds") == 1) & (F.size("b.sounds") == 2) & (F.col("a.legal") == ""))
    scored = met.withColumn("spelt", spelt).where(enough & (f("spelt") >= -7.5)).select(f("nth").alias("variant"), "cluster", (f("spelt") + form + mark + F.log(f("b.rows") + 1.0) * 0.3).alias("posterior"))
    best = scored.groupBy("variant", "cluster").agg(F.max("posterior").alias("posterior"))
    by = Window.partitionBy("variant").orderBy(F.desc("posterior"), "cluster")
    best = best.withColumn("k", F.row_number().over(by)).where("k = 1").select(f("variant").alias("nth"), "cluster")
    meant = open_.join(texts.select("text", "nth"), "text").join(best, "nth").select("id", "cluster")
    return rows.select(f("id").alias("key_a"), "cluster").join(meant.select(f("id").alias("key_b"), "cluster"), "cluster").select("key_a", "key_b")


# --- persons -----------------------------------------------------------------------------------------------------


def person_entries(spark: SparkSession, people: DataFrame, roles: DataFrame | None, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, heads)``: people rows with what they are compared by, and the ``entry_heads`` of the distinct entries among them."""
    f = F.col
    nation = F.element_at("record", F.lit("nationality"))
    base = people.select(
        "id", "name", "source", "source_id", "country", nation.alias("nationality"), "known_for_role", "known_for_org_id",
        F.when(~names.stand_in(f("known_for_org")), compact(f("known_for_org"))).alias("employer"),
        F.when(f("birth_date").rlike(r"^\d{4}-\d{2}(-\d{2})?$") & ~f("birth_date").isin(*names.FILLER_DATES), f("birth_date")).alias("birth"),
        personnames.sounds(F.when(names.stand_in(f("name")), F.lit("")).otherwise(f("name"))).alias("sounds"),
    )
    base = base.join(countries.select(f("value").alias("country"), f("code").alias("c1")), "country", "left")
    base = base.join(countries.select(f("value").alias("nationality"), f("code").alias("c2")), "nationality", "left")
    if roles is not None:
        coded = cut(canonical_roles(spark, people.select(f("known_for_role").alias("value")), roles).where("code is not null").select(f("value").alias("known_for_role"), f("code").alias("role")))
        base = base.join(coded, "known_for_role", "left")
    else:
        base = base.withColumn("role", f("known_for_role"))
    org = F.when(f("known_for_org_id").isNotNull(), F.concat(F.lit("#"), f("known_for_org_id"))).otherwise(f("employer"))
    base = base.select("id", "name", "sounds", "birth", F.coalesce("c2", "c1").alias("nation"), "role", F.when(org.isNotNull(), F.xxhash64(org)).alias("org"), F.xxhash64(F.concat_ws("|", "source", "source_id")).alias("origin"))
    # equal entries get one number: the smallest id with the same hash of all that is compared
    same = F.xxhash64("sounds", "birth", "nation", "role", "org", "origin")
    rows = cut(base.where("size(sounds) > 0").withColumn("same", same).withColumn("text", F.xxhash64(F.array_sort("sounds"))))
    return rows, entry_heads(rows)


def person_pairs(spark: SparkSession, people: DataFrame, roles: DataFrame | None, countries: DataFrame) -> DataFrame:
    """``(key_a, key_b)``: rows of one person whose names are not exactly equal.

    Entries (equal name words and facts) meet where a word of their names and the initial of another one are the same and
    with them the month of birth, or where the initials of two words are the same and with them the day of birth or the
    employer, or all words and the nation; entries of one source record meet its first; how common or short a word is makes no difference. An employer of more than a twentieth of all entries says little: its
    key also takes the month of birth, or a whole word and the nation, or all words.
    Each entry is attached to the better-ranked entry (spellings used more
    often, fuller names) with the largest posterior: log frequency, likelihood of the writing, and the odds of birth date,
    nation, role, employer and source record; below ``0`` it stays on its own. Pairs come from the clusters.
    """
    f = F.col
    rows, heads = person_entries(spark, people, roles, countries)
    n = heads.count()
    employers = rows.where("org is not null").groupBy("org").agg(F.log(F.lit(n + 1.0) / F.count(F.lit(1))).alias("org_odds")).where(f("org_odds") < 6.0)
    entered = rows.join(heads.select(f("nth").alias("id"), "uses"), "id").withColumnRenamed("id", "nth")
    grouped = cut(entered.join(cut(employers), "org", "left").select("nth", "sounds", "birth", "nation", "role", "org", F.coalesce("org_odds", F.lit(6.0)).alias("org_odds"), "origin", "uses", "text"))
    full = F.aggregate("sounds", F.lit(0), lambda t, w: t + F.when(F.length(w) > 1, 1).otherwise(0))
    rank = f("uses") * 32 + F.least(full, F.lit(15)) * 2 + F.when(F.length("birth") == 10, 1).otherwise(0)
    # as numbers: a day is yyyymmdd, a month yyyymm00
    number = F.rpad(F.regexp_replace("birth", "-", ""), 8, "0").cast("int")
    facts = grouped.where("size(sounds) >= 2").select("nth", rank.alias("rank"), number.alias("number"), F.when(f("nation").isNotNull(), F.hash("nation")).alias("code"), "birth", "nation", "org", "org_odds", "text", "sounds")
    # any two words, in their order, by rows: compiled, as functions of arrays are not
    pairs = facts.select("*", F.posexplode("sounds").alias("i", "x")).select("*", F.posexplode("sounds").alias("j", "y")).where("i < j").drop("sounds")
    first = lambda w: F.substring(w, 1, 1)
    # a word and the initial of another one; the initials of any two words
    tags = [F.when(f("x") != f("y"), F.xxhash64(w, first(v))) for w, v in (("x", "y"), ("y", "x"))]
    two = F.xxhash64(F.least(first("x"), first("y")), F.greatest(first("x"), first("y")))
    month, hot = F.substring("birth", 1, 7), f("org_odds") < 3.0
    own = F.when((f("i") == 0) & (f("j") == 1), f("text"))
    made = lambda sign, known, by, *facts: [F.when(known & t.isNotNull(), F.xxhash64(F.lit(sign), t, *facts)) for t in by]
    made = F.array(
        *made("m", f("birth").isNotNull(), tags, month),
        *made("d", F.length("birth") == 10, [two], f("birth")),
        *made("o", f("org").isNotNull() & ~hot, [two], f("org")),
        *made("h", f("org").isNotNull() & hot & f("nation").isNotNull(), tags, f("nation"), f("org")),
        *made("k", f("org").isNotNull() & hot & f("birth").isNotNull(), [two], f("org"), month),
        *made("w", f("org").isNotNull() & hot, [own], f("org")),
        *made("n", f("nation").isNotNull(), [own], f("nation")),
    )
    keyed = pairs.select("nth", "rank", F.explode(made).alias("key"), f("number").alias("birth"), f("code").alias("nation")).where("key is not null")
    year = lambda side: F.floor(f(f"{side}.birth") / 10000)
    fits = (f("l.birth").isNull() | f("r.birth").isNull() | (F.abs(year("l") - year("r")) <= 1)) & (f("l.nation").isNull() | f("r.nation").isNull() | (f("l.nation") == f("r.nation")) | (f("l.birth") == f("r.birth")))
    side = F.struct("sounds", "birth", "nation", "role", "org", "org_odds", "origin", "uses")
    # entries of one source record: each with the first of them
    records = grouped.where("origin is not null and size(sounds) >= 2").select("origin", "nth")
    firsts = records.groupBy("origin").agg(F.min("nth").alias("candidate"))
    stars = records.join(firsts, "origin").where("nth <> candidate").select(f("nth").alias("variant"), "candidate")
    met = with_sides(ranked_pairs(keyed, fits).unionByName(stars), grouped, side)
    scored = met.select("variant", "candidate", person_posterior().alias("posterior"))
    found = cut(components(attribute(scored, 3.0, above=0.0), "variant", "canonical").select(f("node").alias("nth"), f("root").alias("cluster")), replaces=grouped)
    # an entry of no cluster is one of its own, if it has several rows
    meant = heads.join(found, "nth", "left").where("cluster is not null or rows > 1").select("same", F.coalesce("cluster", "nth").alias("cluster"))
    member = cut(rows.select("id", "name", "same").join(meant, "same").select("id", "name", "cluster"), replaces=rows)
    a, b = member.alias("a"), member.alias("b")
    return a.join(b, f("a.cluster") == f("b.cluster")).where("a.id < b.id and not (a.name <=> b.name)").select(f("a.id").alias("key_a"), f("b.id").alias("key_b"))


def person_posterior() -> Column:
    """Log odds that the entries ``a`` and ``b`` are one person."""
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = lambda c: x(c).isNotNull() & y(c).isNotNull()
    same = lambda c: F.coalesce(x(c) == y(c), F.lit(False))
    written = name_likelihood(x("sounds"), y("sounds"))
    matched = F.least(F.size(x("sounds")), F.size(y("sounds"))) >= 2
    whole = (F.length(x("birth")) == 10) & (F.length(y("birth")) == 10)
    part = lambda c, i, n: F.substring(c, i, n)
    month = part(x("birth"), 1, 7) == part(y("birth"), 1, 7)
    day_month = part(x("birth"), 6, 5) == part(y("birth"), 6, 5)
    turned = (part(x("birth"), 1, 4) == part(y("birth"), 1, 4)) & (part(x("birth"), 6, 2) == part(y("birth"), 9, 2)) & (part(x("birth"), 9, 2) == part(y("birth"), 6, 2))
    edits = F.levenshtein(x("birth"), y("birth"))
    year_off = F.abs(part(x("birth"), 1, 4).cast("int") - part(y("birth"), 1, 4).cast("int")) <= 1
    slip = whole & (turned | (day_month & year_off) | ((edits == 1) & (part(x("birth"), 1, 4) == part(y("birth"), 1, 4))))
    birth = (
        F.when(~both("birth"), 0.0).when(whole & same("birth"), 10.0).when(month & ~whole, 5.0).when(slip, 1.5).when(~whole & year_off & (part(x("birth"), 6, 2) == part(y("birth"), 6, 2)), -0.5)
        .otherwise(-9.0)
    )
    nation = F.when(~both("nation"), 0.0).when(same("nation"), 1.5).otherwise(-5.0)
    role = F.when(~both("role"), 0.0).when(same("role"), 1.5).otherwise(-2.0)
    org = F.when(~both("org"), 0.0).when(same("org"), F.least(F.greatest(x("org_odds"), F.lit(0.0)), F.lit(6.0))).otherwise(-0.3)
    origin = F.when(same("origin"), 9.0).otherwise(0.0)
    facts = F.log(y("uses") + 1.0) * 0.2 + birth + nation + role + org + origin - 3.5
    # the writing only lowers the odds: it is weighed where the facts leave something to lower
    return F.when(matched & (facts > 0), F.when(written > -9.5, facts + written)).otherwise(F.lit(None))


def spelling_variants(spark: SparkSession, orgs: DataFrame, people: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``(kind, key_a, key_b)``: persons, organizations of one source, and employers that are the same under different spellings.

    See ``person_pairs``, ``org_pairs`` and ``employer_pairs`` for the three kinds. NULL, blank and stand-in names have no
    words and no variants; missing facts neither speak for nor against a pair; equal names are no variants; repeated rows
    are pairs of their own with every row written otherwise; extra columns are not read; empty tables give no pairs.
    """
    entered = orgs.select(F.col("region").alias("value")).union(people.select("country")).union(people.select(F.element_at("record", F.lit("nationality"))))
    countries = cut(canonical_countries(spark, entered).where("code is not null").select("value", "code"))  # distinct values: small, and broadcast if measured so
    rows, spelled = org_clusters(orgs, countries)
    out = person_pairs(spark, people, roles, countries).select(F.lit("person").alias("kind"), "key_a", "key_b")
    out = out.unionByName(org_pairs(orgs, rows).select(F.lit("org").alias("kind"), "key_a", "key_b"))
    return out.unionByName(employer_pairs(people, orgs, rows, spelled).select(F.lit("employer").alias("kind"), "key_a", "key_b"))
