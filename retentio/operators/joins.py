"""Join helpers: broadcast only behind a size check.

Spark plans a broadcast of its own where it estimates a side at less than
``spark.sql.autoBroadcastJoinThreshold``, and it estimates a Parquet scan by the
compressed files and the share of the columns read: one key of a wide table
of ten million rows counts as a few MB.  A side that was measured too
large, or that is as long as the input, therefore asks for a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, whatever size Spark estimates."""
    return df.hint("shuffle_merge")


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows and ``max_bytes``
    bytes, both measured, else leave it to a shuffle join (where AQE's skew-join
    split still applies).

    The measurement runs a job, so pass tables that are cheap to read:
    checkpointed dimensions, offsets tables, aggregated lookups.
    Rows are counted first, which reads no column of a stored table; only of one
    with few enough are the bytes summed.  No row is moved for either.
    """
    if df.count() > max_rows:
        return df
    width = F.lit(8)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) + 16 if isinstance(f.dataType, (StringType, BinaryType))
                         else F.lit(max(8, 16 if "decimal" in f.dataType.simpleString() else 8)))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def broadcast_or_merge(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast_if_small``; a ``df`` that is not small is never broadcast."""
    sized = broadcast_if_small(df, max_rows, max_bytes)
    return never_broadcast(df) if sized is df else sized
