"""Tokenisation, the same rule for the DataFrame and the ML path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of two or more letters, digits or underscores, in lower case.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def bucket(token: Column, buckets: int) -> Column:
    """The bucket of a token that is not null: the first 32 bits of its MD5 digest, modulo ``buckets``. Its type says
    that it is never null: a join on it then adds no filter, and counts by it are worked out once for all their uses."""
    number = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets
    return F.coalesce(number, F.lit(0).cast("bigint"))
