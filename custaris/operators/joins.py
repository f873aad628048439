"""Join helpers: broadcast only behind a size check.

``bounded_broadcast`` counts at most ``max_rows + 1`` rows (a LIMIT job that
stops early) and hints a broadcast only when the side is proven small; above
the bound the plain DataFrame is returned and Spark plans a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast-hinted ``df`` if it has at most ``max_rows`` rows, else ``df``."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def one_row(df: DataFrame) -> DataFrame:
    """Mark a global (no-key) aggregate as broadcastable: it has exactly one row."""
    return F.broadcast(df)
