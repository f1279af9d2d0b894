"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metadata frames (policies, mappings, rules, schedules) are broadcast only within these bounds; beyond them the
# join is left to Spark's planner and AQE.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when a look at it proves at most ``max_rows`` rows and ``max_bytes`` of text.

    The look takes ``limit(max_rows + 1)``, so checking a huge frame costs at most that many rows; beyond the
    bounds the frame is returned as it is and Spark picks a shuffle join.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    n, text = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= max_rows and (text or 0) <= max_bytes else df


def broadcast_known(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame built from a driver-side list of ``n_rows`` items when that is small."""
    return F.broadcast(df) if n_rows <= max_rows else df
