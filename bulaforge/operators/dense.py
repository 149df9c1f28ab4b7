"""Exact vector retrieval: cosine similarity inside the JVM, top-k by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulaforge.operators.lexical import top_k

SIMILARITY = 0.30


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has norm 0."""
    return F.coalesce(_dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def search(queries: DataFrame, vectors: DataFrame, qid: str, key: str, k: int = 8, least: float | None = SIMILARITY, where: Column | None = None) -> DataFrame:
    """queries(qid, q), vectors(key, v, …) → (qid, key, score, rank).

    The stated query set is scored against all vectors in blocks: Spark streams the
    vectors past each block of queries. `where` filters vectors before scoring.
    """
    base = vectors if where is None else vectors.where(where)
    base = base.withColumn("vn", norm(F.col("v")))
    asked = queries.withColumn("qn", norm(F.col("q")))
    scored = base.join(asked, F.lit(True)).select(qid, key, F.coalesce(_dot(F.col("q"), F.col("v")) / F.nullif(F.col("qn") * F.col("vn"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    if least is not None:
        scored = scored.where(F.round("score", 9) >= least)
    return top_k(scored, qid, [F.col(key)], k)
