"""Counting tokens the plain way: runs of letters, digits and underscores, or single other signs."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Java's pattern of the same tokens that Python's \w+|[^\w\s] finds.
TOKEN_JAVA = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}\x{1c}-\x{1f}]"
TOKEN = re.compile(r"\w+|[^\w\s]")


def token_count(text: Column) -> Column:
    """Tokens of a text, inside the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_JAVA)), F.lit(0))
