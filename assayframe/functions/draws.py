"""Deterministic draws: every random choice is an order by a salted md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hash(seed: int, label: Column | str, row_id: Column | str) -> Column:
    """md5('seed:label:row_id'); the order of these strings is the draw order."""
    label = F.lit(label) if isinstance(label, str) else label
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws(":", F.lit(str(seed)), label, row_id.cast("string")))


def hash_int(h: Column, digits: int = 8) -> Column:
    """Leading hex digits of a hash as a bigint."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")
