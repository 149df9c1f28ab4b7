"""Key-value cache as a table: validity by expiry, latest value per key, read-through split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Entries without expiry or not yet past it; an entry is still valid at the very moment it expires."""
    return entries.where(F.col(expires).isNull() | (now <= F.col(expires)))


def latest(entries: DataFrame, keys: list[str], stored: str) -> DataFrame:
    """The last stored row per key (keep-latest upsert), by aggregation instead of a window over whole rows."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stored, *[c for c in rest if c != stored])).alias("r")).select(*keys, "r.*").select(*entries.columns)


def split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a read-through."""
    known = cache.select(key).distinct()
    return wanted.join(known, key, "left_semi"), wanted.join(known, key, "left_anti")


def read_through(wanted: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with the cached value and `via`: cache where the key is known, else null and compute."""
    return wanted.join(cache.select(key, value), key, "left").withColumn("via", F.when(F.col(value).isNotNull(), "cache").otherwise("compute"))
