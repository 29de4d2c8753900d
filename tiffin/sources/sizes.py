"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether the table fits the bound; counting stops one row past it."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows.

    Beyond the bound the join shuffles, with skewed partitions split at run time.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df
