"""The streaming twin of gap_sessions, for logs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(rows: DataFrame, keys: list[str], gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Sessions (keys, start, end, n) of a stream or table with a timestamp column ts.

    A session ends when no row comes for the gap; rows later than the lateness are left out, and state is kept no longer
    than both. On a stream, sessions come out once they are closed (append mode).
    """
    watched = rows.withWatermark("ts", lateness) if rows.isStreaming else rows
    found = watched.groupBy(*keys, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
