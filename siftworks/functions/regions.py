"""Regions as ISO country codes by exact lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import ELSEWHERE, EUROPE, STATE_CODES, UNITED_STATES

# Names of the United Kingdom and the United States that lookups by name miss.
ALIASES = {
    "uk": "GB", "u.k.": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "britain": "GB", "great britain": "GB",
    "usa": "US", "u.s.a.": "US", "u.s.": "US", "united states of america": "US", "america": "US",
}
# ISO three-letter codes.
ALPHA3 = (
    "GBR GB USA US DEU DE FRA FR ESP ES ITA IT NLD NL CAN CA BEL BE CHE CH AUT AT AUS AU IRL IE SWE SE NOR NO DNK DK FIN FI POL PL CZE CZ PRT PT GRC GR HUN HU ROU RO JPN JP CHN CN IND IN KOR KR BRA BR MEX MX ZAF ZA "
    "NZL NZ SGP SG HKG HK LUX LU ARE AE TUR TR ISR IL ARG AR CHL CL KEN KE"
).split()


def fixed_lookup() -> list[tuple[str, str, int]]:
    """``(lower-case spelling, code, priority)``; the smallest priority wins."""
    rows = [(k, v, 0) for k, v in ALIASES.items()]
    rows += [(c.lower(), "US", 2) for c in STATE_CODES.split()]
    rows += [(a.lower(), b, 3) for a, b in zip(ALPHA3[::2], ALPHA3[1::2])]
    rows += [(n.lower(), "US", 4) for n in UNITED_STATES.split(";")]
    rows += [(n.lower(), code, 5) for group in (EUROPE, ELSEWHERE) for code, names in group.items() for n in names.split(";")]
    return rows


def region_lookup(spark: SparkSession, countries: DataFrame) -> DataFrame:
    """``(spelling, iso)`` of the fixed names and of a table ``code, name``; one row a spelling."""
    fixed = spark.createDataFrame(fixed_lookup(), "spelling string, iso string, priority int")
    listed = countries.select(F.lower("code").alias("spelling"), F.col("code").alias("iso"), F.lit(1).alias("priority")).union(countries.select(F.lower("name"), "code", F.lit(4)))
    return fixed.union(listed).groupBy("spelling").agg(F.min_by("iso", F.struct("priority", "iso")).alias("iso"))


def with_region(rows: DataFrame, column: str, lookup: DataFrame, out: str = "iso") -> DataFrame:
    """``rows`` with the ISO code of ``column``, '' where it is unknown. The lookup has a few hundred rows and is broadcast."""
    known = lookup.withColumnRenamed("iso", "_iso").withColumnRenamed("spelling", "_spelling")
    return rows.join(F.broadcast(known), F.lower(F.trim(F.col(column))) == F.col("_spelling"), "left").withColumn(out, F.coalesce("_iso", F.lit(""))).drop("_iso", "_spelling")


def sql_lookup() -> str:
    values = ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', '{c}', {p})" for s, c, p in fixed_lookup())
    return f"""lookup as (select spelling, first(iso order by priority, iso) as iso from (
      select * from (values {values}) as f(spelling, iso, priority) union all select lower(code), code, 1 from ref_countries union all select lower(name), code, 4 from ref_countries) group by spelling)"""
