"""The enumerations of the entity database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source types by number and name; 5 stands for the standard country list.
SOURCE_TYPES = ((1, "gleif"), (2, "sec_edgar"), (3, "companies_house"), (4, "wikidata"), (5, "pycountry"))
SOURCE_ALIASES = {"wikipedia": "wikidata"}
# Trust in sources, 1 is the highest; others 99.
ORG_PRIORITY = {"gleif": 1, "sec_edgar": 2, "companies_house": 3, "wikidata": 4, "wikipedia": 4}
PERSON_PRIORITY = {"wikidata": 1, "sec_edgar": 2, "companies_house": 3}
OTHER_PRIORITY = 99
# Simplified types of locations.
SIMPLIFIED_LOCATION_TYPES = ("continent", "country", "subdivision", "city", "district", "historic", "other")


def source_types(spark: SparkSession) -> DataFrame:
    """``(source_type_id, source_type)``; a handful of rows, broadcast wherever it is joined."""
    return spark.createDataFrame(list(SOURCE_TYPES), "source_type_id int, source_type string")
