"""Statements: parsing of model output, exports and graph projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import xml_escape

STATEMENT_SCHEMA = "stmt array<struct<subject: struct<_VALUE: string, _type: string>, predicate: string, object: struct<_VALUE: string, _type: string>, text: string>>"


def to_xml(subject: Column, predicate: Column, obj: Column, text: Column) -> Column:
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), xml_escape(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>"))
    return F.concat(F.lit("<stmt>"), tag("subject", subject), tag("predicate", predicate), tag("object", obj), tag("text", text), F.lit("</stmt>"))


def repair_xml(text: Column) -> Column:
    """Bare ampersands are escaped, what follows the last whole statement is cut, and missing closing tags are added."""
    safe = F.regexp_replace(text, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    open_ = F.regexp_replace(safe, r"(?s)</statements>.*\z", "")
    whole = F.regexp_replace(open_, r"(?s)(<stmt>(?:(?!</stmt>).)*)\z", "")
    return F.concat(whole, F.lit("</statements>"))


def parse_xml(rows: DataFrame, column: str) -> DataFrame:
    """One row per ``<stmt>`` that has a subject and an object; entity types default to UNKNOWN."""
    parsed = rows.withColumn("_x", F.from_xml(F.col(column), STATEMENT_SCHEMA, {"rowTag": "statements"}))
    each = parsed.select(*[F.col(x) for x in rows.columns], F.posexplode("_x.stmt").alias("position", "_s"))
    value = lambda part: F.col(f"_s.{part}._VALUE")
    kind = lambda part: F.upper(F.coalesce(F.col(f"_s.{part}._type"), F.lit("UNKNOWN")))
    out = each.select(*[F.col(x) for x in rows.columns], "position", value("subject").alias("subject"), kind("subject").alias("subject_type"), F.col("_s.predicate").alias("predicate"), value("object").alias("object"), kind("object").alias("object_type"), F.col("_s.text").alias("text"))
    return out.where("trim(subject) <> '' and trim(object) <> ''")


def parse_any(rows: DataFrame, column: str) -> DataFrame:
    """Statements from JSON (an array, or under ``statements`` or ``labeled_statements``) or XML text; the text defaults to ``s p o``."""
    item = "array<struct<subject: string, predicate: string, object: string, text: string>>"
    raw = F.col(column)
    named = F.from_json(raw, f"struct<labeled_statements: {item}, statements: {item}>")
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, item)).otherwise(F.coalesce(named["labeled_statements"], named["statements"]))
    tags = lambda t: F.regexp_extract(F.col("_s"), rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1)
    as_json = rows.select("*", F.explode(listed).alias("_s")).select(*rows.columns, "_s.*")
    as_xml = rows.where(F.ltrim(column).startswith("<")).select("*", F.explode(F.regexp_extract_all(raw, F.lit(r"(?s)<stmt>(.*?)</stmt>"), F.lit(1))).alias("_s")).select(
        *rows.columns, *[F.nullif(tags(t), F.lit("")).alias(t) for t in ("subject", "predicate", "object", "text")]
    )
    both = as_json.unionByName(as_xml).where("subject is not null and predicate is not null")
    return both.withColumn("text", F.coalesce("text", F.concat_ws(" ", "subject", "predicate", "object")))


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def graph_nodes(rows: DataFrame) -> DataFrame:
    """``(entity, first_seq)``: each entity of the statements and where it is first seen; a partial minimum, no sort."""
    return rows.select("seq", F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.min("seq").alias("first_seq"))


def numbered_nodes(rows: DataFrame) -> DataFrame:
    """``(entity, node)`` numbered from 0 in order of first sight; ranks come from a range sort and its partitions' counts."""
    nodes = graph_nodes(rows).repartitionByRange("first_seq", "entity").withColumn("_p", F.spark_partition_id())
    counts = nodes.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("first_seq", "entity")) - 1
    return nodes.withColumn("_i", inside).join(F.broadcast(before), "_p").select("entity", (F.col("_i") + F.col("_b")).alias("node"))


def relation_type(predicate: Column) -> Column:
    return F.regexp_replace(F.upper(predicate), "[^A-Z0-9]", "_")
