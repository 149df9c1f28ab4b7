"""Reciprocal-rank fusion, context expansion and the running character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank constant, least rest worth cutting a text for.
RRF_K = 60
LEAST_REST = 200


def fuse(lexical: DataFrame, dense: DataFrame, qid: str, key: str, k: int = 8) -> DataFrame:
    """(qid, key, score, score_kind, rank). Where one side found nothing for a question, the other side's own
    scores stand; else ranks are fused. One union and one grouping, no full outer join."""
    both = lexical.select(qid, key, "score", "rank", F.lit("bm25").alias("src")).unionByName(dense.select(qid, key, "score", "rank", F.lit("cosine").alias("src")))
    side = Window.partitionBy(qid)
    both = both.withColumn("sides", F.size(F.collect_set("src").over(side)))
    lex, den = F.when(F.col("src") == "bm25", F.col("rank")), F.when(F.col("src") == "cosine", F.col("rank"))
    merged = both.groupBy(qid, key, "sides").agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("score").alias("own"), F.min(lex).alias("lex_rank"), F.min(den).alias("dense_rank"), F.min("src").alias("src")
    )
    scored = merged.withColumn("score", F.when(F.col("sides") == 2, F.col("rrf")).otherwise(F.col("own"))).withColumn("score_kind", F.when(F.col("sides") == 2, "rrf").otherwise(F.col("src")))
    w = Window.partitionBy(qid).orderBy(F.round("score", 9).desc(), F.col("lex_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qid, key, "score", "score_kind", "rank")


def expand(first: DataFrame, wider: DataFrame, qid: str, key: str) -> DataFrame:
    """first and then wider, each document once, in order of first appearance: (qid, key, ord)."""
    both = first.select(qid, key, F.struct(F.lit(0).alias("part"), "rank").alias("at")).unionByName(wider.select(qid, key, F.struct(F.lit(1).alias("part"), "rank").alias("at")))
    once = both.groupBy(qid, key).agg(F.min("at").alias("at"))
    return once.select(qid, key, F.row_number().over(Window.partitionBy(qid).orderBy("at")).alias("ord"))


def _running(rows: DataFrame, qid: str, order: str, chars: Column, budget: int) -> DataFrame:
    """Rows within the budget, with used, what stands before them. Prefix sums are monotone, so stopping at the first overflow is a filter."""
    w = Window.partitionBy(qid).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("used", F.sum(chars).over(w) - chars)
    return run.where((F.col("used") + chars <= budget) | ((F.col("used") <= budget) & (budget - F.col("used") > LEAST_REST)))


def counted(rows: DataFrame, qid: str, order: str, chars: str, budget: int) -> DataFrame:
    """Rows whose texts `within_budget` keeps, whole or cut, from their lengths."""
    return _running(rows, qid, order, F.col(chars), budget).drop("used")


def within_budget(texts: DataFrame, qid: str, order: str, text: str, budget: int) -> DataFrame:
    """Texts in order while they fit; the first that doesn't is cut to the rest if the rest exceeds LEAST_REST."""
    rest = budget - F.col("used")
    kept = _running(texts, qid, order, F.length(text), budget)
    return kept.withColumn(text, F.when(F.length(text) <= rest, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), rest.cast("int")))).drop("used")
