"""What counts as a usable value in the records of organizations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source trust, 1 is the most trusted.
SOURCE_PRIORITY = {"gleif": 1, "sec_edgar": 2, "companies_house": 3, "wikidata": 4, "wikipedia": 4}
OTHER_PRIORITY = 99
# Stand-ins for a missing name or value, lower case without punctuation at the ends.
STAND_INS = (
    "", "n/a", "na", "n.a", "none", "null", "nil", "nan", "unknown", "unnamed", "not available", "name not available", "no name", "not stated",
    "not known", "not disclosed", "not applicable", "undisclosed", "unspecified", "tbc", "tbd", "tba", "to be confirmed", "test", "xxx", "xx", "x",
    "see record", "see notes", "various", "misc", "other", "anonymous", "company", "name", "dummy", "default", "blank", "empty", "missing", "withheld",
)
# Dates that stand for an unknown day.
FILLER_DATES = ("0000-00-00", "0001-01-01", "1900-01-01", "9999-12-31", "9999-01-01", "9999-99-99")


def source_priority(source: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), source), F.lit(OTHER_PRIORITY))


def lei(source: Column, source_id: Column, record: Column) -> Column:
    """The LEI of a row, 20 upper-case characters, however it is written; NULL if it has none."""
    raw = F.when(source == "gleif", source_id).otherwise(F.element_at(record, F.lit("lei")))
    bare = F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""), "^LEI(?=.{20}$)", "")
    return F.when(F.length(bare) == 20, bare)


def stand_in(value: Column) -> Column:
    """True for NULL, blanks, punctuation and words that stand for no value."""
    # anchored, so that most values are done with at their first letter
    around, inner = r"[\s\p{P}\p{S}]*", "|".join(re.escape(w) for w in STAND_INS)
    return value.isNull() | F.lower(F.trim(value)).rlike(f"^{around}(?:{inner}){around}$")


def usable_name(name: Column, source_id: Column) -> Column:
    """True for a name; false for stand-ins and identifiers (own source id, LEI, QID, registry numbers).

    An identifier is one word of capitals and digits with a digit in it, at least six characters long, perhaps with a
    prefix such as ``LEI:``; a single word with fewer than two letters is none either.
    """
    bare = F.upper(F.trim(name))
    code = bare.rlike(r"^(?:[A-Z]{2,8}[-:#/ ]{1,2})?(?=[A-Z0-9-]*[0-9])[A-Z0-9][A-Z0-9-]{4,}$") & ~F.trim(name).rlike(r"\p{Ll}{2}")
    return ~stand_in(name) & ~code & ~(bare == F.upper(F.trim(F.coalesce(source_id, F.lit(""))))) & name.rlike(r"\p{L}.*\p{L}")


def usable_date(value: Column) -> Column:
    """True for a whole, real day written YYYY-MM-DD that is no filler."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull() & ~value.isin(*FILLER_DATES) & ~value.rlike("^(0000|9999)"), F.lit(False))
