"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, table
from . import names
from .canonical import canonical_countries, canonical_roles
from .cascade import match_sources, row_pairs
from .components import consolidate
from .mix import mix
from .orgs import source_groups
from .pack import pack
from .split import split_documents
from .survivors import survivors
from .tokens import token_count
from .variants import spelling_variants


def _limits(spark: SparkSession, d: str, task: str) -> tuple[int, int]:
    row = table(spark, d, "token_limits").where(F.col("task") == task).first()
    return row["max_tokens"], row["overlap_tokens"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    orgs = table(spark, d, "organizations").select("id", "name", "source", "source_id", "from_date", "record", "loaded_at")
    members = cut(orgs.join(source_groups(orgs), "id").select("group_id", "id", "name", "source", "source_id", "from_date", "loaded_at"))
    field = F.explode(
        F.array(
            F.struct(F.lit("name").alias("field"), F.when(names.usable_name(F.col("name"), F.col("source_id")), F.col("name")).alias("value")),
            F.struct(F.lit("from_date").alias("field"), F.when(names.usable_date(F.col("from_date")), F.col("from_date")).alias("value")),
        )
    )
    long = members.select("group_id", "id", "source", "loaded_at", field.alias("f")).select("group_id", "id", "source", "loaded_at", "f.*")
    best = survivors(long, ["group_id", "field"], names.source_priority(F.col("source")), F.col("loaded_at").cast("timestamp"))
    wide = best.groupBy("group_id").agg(
        F.max(F.when(F.col("field") == "name", F.col("row_id"))).alias("name_row_id"), F.max(F.when(F.col("field") == "from_date", F.col("row_id"))).alias("from_date_row_id")
    )
    whole = members.select("group_id").distinct().join(wide, "group_id", "left")
    return whole.select("group_id", F.coalesce("name_row_id", F.lit(0)).alias("name_row_id"), F.coalesce("from_date_row_id", F.lit(0)).alias("from_date_row_id"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the surviving record, voted: name, source, from_date and each entry of record."""
    orgs = table(spark, d, "organizations").select("id", "name", "source", "source_id", "from_date", "record", "loaded_at")
    members = orgs.join(source_groups(orgs), "id")
    entries = F.transform(F.map_entries(F.coalesce("record", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("record."), e["key"]).alias("field"), F.when(~names.stand_in(e["value"]), e["value"]).alias("value")))
    fields = F.concat(
        F.array(
            F.struct(F.lit("name").alias("field"), F.when(names.usable_name(F.col("name"), F.col("source_id")), F.col("name")).alias("value")),
            F.struct(F.lit("source").alias("field"), F.col("source").alias("value")),
            F.struct(F.lit("from_date").alias("field"), F.when(names.usable_date(F.col("from_date")), F.col("from_date")).alias("value")),
        ),
        entries,
    )
    long = members.select("group_id", "id", "source", "loaded_at", F.explode(fields).alias("f")).select("group_id", "id", "source", "loaded_at", "f.*")
    best = survivors(long, ["group_id", "field"], names.source_priority(F.col("source")), F.col("loaded_at").cast("timestamp"), priority=False)
    pick = lambda name: F.max(F.when(F.col("field") == name, F.col("value"))).alias(name)
    entry = F.when(F.col("field").startswith("record."), F.struct(F.expr("substr(field, 8)").alias("key"), F.col("value").alias("value")))
    return best.groupBy("group_id").agg(pick("name"), pick("source"), pick("from_date"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("record"))


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every matched pair of rows with the rule that found it and its confidence."""
    orgs = table(spark, d, "organizations").select("id", "name", "source", "source_id", "region", "from_date", "record")
    return row_pairs(orgs, source_groups(orgs), match_sources(spark, orgs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("id_a", "id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    orgs, people = table(spark, d, "organizations"), table(spark, d, "people")
    countries, roles = table(spark, d, "ref_countries"), table(spark, d, "ref_roles")
    entered = orgs.select(F.lit("organizations.region").alias("field"), "id", F.col("region").alias("value")).unionByName(
        people.select(F.explode(F.array(F.struct(F.lit("people.country").alias("field"), "id", F.col("country").alias("value")),
                                        F.struct(F.lit("people.known_for_role").alias("field"), "id", F.col("known_for_role").alias("value")))).alias("r")).select("r.*")
    )
    entered = entered.where("value is not null and value <> ''")
    role = F.col("field") == "people.known_for_role"
    listed = countries.select(F.col("name").alias("value")).union(countries.select("code")).select("value", F.lit(False).alias("role")).union(roles.select("title", F.lit(True))).distinct()
    entered = entered.withColumn("role", role).join(F.broadcast(listed), ["value", "role"], "left_anti")  # the list has one row an entry
    values = cut(entered.groupBy("value", "role").count().select("value", "role"))
    codes = canonical_countries(spark, values.where("not role")).join(countries.select("code").distinct(), "code", "left_semi").select("value", F.lit(False).alias("role"), "code")
    codes = codes.unionByName(canonical_roles(spark, values.where("role"), roles).select("value", F.lit(True).alias("role"), "code"))
    return entered.join(codes, ["value", "role"], "left").select("field", "id", F.coalesce("code", F.lit("UNMATCHED")).alias("code"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    orgs = table(spark, d, "organizations").select("id", "name", "source", "source_id", "region", "from_date", "record")
    people = table(spark, d, "people").select("id", "name", "source", "source_id", "country", "known_for_role", "known_for_org", "known_for_org_id", "birth_date", "record")
    return spelling_variants(spark, orgs, people, table(spark, d, "ref_roles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "role_records"), table(spark, d, "role_matches"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return pack(docs, _limits(spark, d, "pack")[0])


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return mix(docs, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(table(spark, d, "documents"), *_limits(spark, d, "split"), with_text=False)
    return pieces.where("piece_no = 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), *_limits(spark, d, "split"))


QUERIES = {
    "p1_found": p1_found, "p1_survivors": p1_survivors, "p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_containers": p7_containers,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_pieces": p9_pieces,
}
