"""Counter-based randomness: a draw is a hash of its key, so it does not depend on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal


def uniform(*key: Column) -> Column:
    """In (0, 1): the first 52 bits of the md5 of the key's parts, joined by bars."""
    digest = F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def uniform_sql(*key: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"((CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def gaussian(*key: Column) -> Column:
    return normal.inverse(uniform(*key))
