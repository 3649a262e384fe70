"""Size guards for the few places where a side is broadcast or a small table is collected.

``bounded_broadcast`` counts at most ``max_rows + 1`` rows of the side (a limit, so a large
side stops early) and only then hints a broadcast; above the bound the plain DataFrame is
returned and Spark plans a shuffle join instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> int:
    return df.limit(max_rows + 1).count()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    if row_count_at_most(df, max_rows) <= max_rows:
        return F.broadcast(df)
    return df


def collect_bounded(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"refusing to collect more than {max_rows} rows to the driver")
    return rows
