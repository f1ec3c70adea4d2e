"""The token of this project: an unbroken run of letters, digits and underscores, or any other single character that is not white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same token in Java's and in Python's regular expressions.
JAVA_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
PYTHON_TOKEN = r"\w+|[^\w\s]"


def token_count(text: Column) -> Column:
    """Number of tokens as BIGINT; NULL and blank texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_TOKEN)), F.lit(0)).cast("bigint")
