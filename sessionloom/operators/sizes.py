"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side that was counted to be small; a larger one is left to a shuffled join with run-time skew handling.

    For narrow tables (a few short strings per row). The count stops at the limit.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
