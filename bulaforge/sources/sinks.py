"""Sinks: JSON reports, event frames and keep-latest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulaforge.operators.cachestore import latest


def frame(payload: Column) -> Column:
    """One server-sent event: `data: {json}` and a blank line."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def write_report(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, atomically by the commit protocol, partitioned by run."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def upsert(existing: DataFrame | None, fresh: DataFrame, keys: list[str], stored: str, path: str) -> None:
    """Write the latest row per key of both to path, which must not be the one `existing` is read from."""
    whole = fresh if existing is None else existing.unionByName(fresh)
    latest(whole, keys, stored).write.mode("overwrite").parquet(path)
