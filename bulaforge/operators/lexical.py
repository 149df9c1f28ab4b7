"""BM25 retrieval as term joins and sums; questions and documents are both DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bulaforge.functions.text import tokens

# Fixed values of the score.
K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) and (key, dl): term counts, and token counts with the documents that have none."""
    tokenized = docs.select(key, tokens(F.col(text)).alias("ts"))
    counted = tokenized.select(key, F.explode("ts").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counted, tokenized.select(key, F.size("ts").alias("dl"))


def scores(questions: DataFrame, docs: DataFrame, qid: str, question: str, key: str, text: str) -> DataFrame:
    """(qid, key, score) of every document with a term of the question. A repeated query term counts again.

    Only occurrences of the questions' terms are shuffled: the documents' tokens are
    filtered by the terms before they are counted, and each carries its document's length.
    The document frequency is still taken over all documents.
    """
    tokenized = docs.select(key, tokens(F.col(text)).alias("ts"))
    asked = questions.select(qid, F.explode(tokens(F.col(question))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qn"))
    wanted = asked.select("term").distinct()
    seen = tokenized.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi")
    hit = seen.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    whole = tokenized.select(F.size("ts").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(whole)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    pairs = hit.join(weighted, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1.0)))
    return pairs.groupBy(qid, key).agg(F.sum(F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))


def top_k(scored: DataFrame, qid: str, order: list, k: int, score: str = "score") -> DataFrame:
    """Rows of the k best per question with their rank; ties on the rounded score go by `order`."""
    w = Window.partitionBy(qid).orderBy(F.round(score, 9).desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(questions: DataFrame, docs: DataFrame, qid: str, question: str, key: str, text: str, k: int = 8) -> DataFrame:
    """(qid, key, score, rank): BM25 top-k; a question without tokens gets the first k documents with score 0."""
    found = top_k(scores(questions, docs, qid, question, key, text).where("score > 0"), qid, [F.col(key)], k)
    blank = questions.where(F.size(tokens(F.col(question))) == 0).select(qid)
    first = docs.select(key).orderBy(key).limit(k)
    empty = top_k(blank.join(F.broadcast(first)).withColumn("score", F.lit(0.0)), qid, [F.col(key)], k)
    return found.unionByName(empty)
