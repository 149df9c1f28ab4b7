"""Run reports: step durations and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_report(timings: DataFrame, step: str, seconds: str) -> DataFrame:
    """(step, seconds, share, place): summed per step, share of all, longest first."""
    summed = timings.groupBy(step).agg(F.sum(seconds).alias("seconds"))
    whole = Window.partitionBy()
    shared = summed.withColumn("share", F.coalesce(F.try_divide(F.col("seconds"), F.sum("seconds").over(whole)), F.lit(0.0)))
    return shared.withColumn("place", F.row_number().over(Window.orderBy(F.desc("seconds"), step)))


def run_summary(results: DataFrame, run: list[str], ok: str, seconds: str) -> DataFrame:
    """(run…, n_ok, n_failed, mean_seconds, total_seconds); means of no success are 0."""
    good = F.when(F.col(ok), F.col(seconds))
    return results.groupBy(*run).agg(
        F.count_if(F.col(ok)).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_failed"), F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_seconds"), F.coalesce(F.sum(good), F.lit(0.0)).alias("total_seconds")
    )
