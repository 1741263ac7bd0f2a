"""Sides that may be broadcast, checked before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stated(df: DataFrame, limit: int, what: str) -> DataFrame:
    """A stated small set with a broadcast hint; more rows than `limit` are refused, so that the
    caller passes them in blocks."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} {what} at once; pass them in blocks")
    return F.broadcast(df)
