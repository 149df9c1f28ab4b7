"""Tables from layout spans: rows by jumps of the vertical position, as a sessionisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_JUMP = 5


def detect_tables(spans: DataFrame, page: list[str]) -> DataFrame:
    """spans(page…, ord, text, x, y) → (page…, table_text): pages with at least two rows of two or more spans and
    at most three different row widths. Blank spans don't count."""
    w = Window.partitionBy(*page).orderBy("ord")
    full = spans.where(F.col("text").rlike(r"[^\s\u00a0]")).withColumn("jump", F.when(F.abs(F.col("y") - F.lag("y").over(w)) > ROW_JUMP, 1).otherwise(0))
    rows = full.withColumn("row", F.sum("jump").over(w)).groupBy(*page, "row").agg(F.sort_array(F.collect_list(F.struct("x", "ord", F.trim("text").alias("t")))).alias("cells"))
    rows = rows.where(F.size("cells") >= 2).withColumn("line", F.array_join(F.transform("cells", lambda c: c.t), " | "))
    whole = rows.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("lines"), F.countDistinct(F.size("cells")).alias("widths"))
    whole = whole.where((F.size("lines") >= 2) & (F.col("widths") <= 3))
    head = F.get("lines", F.lit(0)).line
    rest = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda r: r.line)
    return whole.select(*page, F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), F.length(head))), rest), "\n").alias("table_text"))
