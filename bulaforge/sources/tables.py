"""Parquet table source: one path convention, explicit column pruning, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read `<base>/<name>.parquet`; `columns` prunes the scan."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def once_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Repeated rows carry the same content, so any of them serves;
    where `ingested_at` is present the earliest one is kept, which makes the choice definite."""
    if "ingested_at" not in df.columns:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    # The rank is a struct, so equal arrival times still give one definite row.
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(F.col("ingested_at").isNull().alias("n"), F.col("ingested_at").alias("t"))).alias("_r")
    )
    return picked.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)
