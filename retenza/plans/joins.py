"""Join helpers: broadcast only behind a size check.

``sized_join`` estimates how large the side that might be broadcast is as
rows in memory: Catalyst's estimate for a scan counts compressed file
bytes, so it is multiplied by ``DECODED`` before it is held against the
bound. Below the bound the side gets a broadcast hint. Above it (or without
an estimate) the join is left to AQE, which re-plans from measured sizes
and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024
#: Decoded rows in a hash table take about so many times their Parquet bytes.
DECODED = 8


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df`` as decoded rows (None when unavailable)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return DECODED * int(str(stats.sizeInBytes()))
    except Exception:  # Spark Connect or a plan without statistics
        return None


def fits_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= max_bytes


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
               max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join, broadcasting ``right`` only if its estimated size is bounded."""
    if how in ("inner", "left", "left_outer", "left_semi", "left_anti", "cross") \
            and fits_broadcast(right, max_bytes):
        right = F.broadcast(right)
    return left.join(right, on, how)
