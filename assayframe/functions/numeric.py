"""Null-safe numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six(c: Column) -> Column:
    """Round half up at six decimals with plain arithmetic, so that any engine
    following IEEE doubles gives the same digits; -0.0 becomes 0.0."""
    return F.floor(c * 1e6 + 0.5).cast("double") / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def r_squared(n: Column, sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when predicted exactly and 0
    otherwise; NULL below two rows."""
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0))
        .otherwise(1 - ratio(sse, sst))
    )
