"""Entity resolution: which listing a search term means, with the gap to the runner-up."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of the score and the gap below which a choice is ambiguous.
WEIGHTS = {"name": 0.55, "tokens": 0.25, "species": 0.10, "substance": 0.10}
AMBIGUOUS_GAP = 0.10


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff–Obershelp ratio, case-insensitive; no built-in measures it."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def token_overlap(query: Column, target: Column) -> Column:
    """Share of the distinct query words of three or more characters that occur in the target."""
    words = _words(query)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(target), w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits / F.greatest(F.size(words), F.lit(1)))


def _words(text: Column) -> Column:
    """Distinct words of three or more characters, as `token_overlap` counts them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def candidates(asked: DataFrame, listings: DataFrame, qid: str, term: str, key: str, name: str) -> DataFrame:
    """All pairs where a word of the term stands anywhere in the name, also inside another word.

    A name that holds a word holds each of its character trigrams, so one trigram of the word (the one of the largest
    hash) joins by equality and the containment is verified on what meets. Names without a common trigram never meet."""
    words = asked.select(qid, F.explode(_words(F.col(term))).alias("w"))
    return holding(words, listings.select(key, F.lower(F.col(name)).alias("n")), "w", "n").select(qid, key).distinct()


def holding(words: DataFrame, texts: DataFrame, word: str, text: str, on: list[str] | None = None) -> DataFrame:
    """Pairs of a row of words and a row of texts that contains its word, with equal columns `on`. Words of fewer than three
    characters are left out, or with `on` compared directly."""
    pick = F.array_max(F.transform(_trigrams(F.col(word)), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))).getField("g")
    grams = texts.withColumn("_g", F.explode(_trigrams(F.col(text))))
    long = words.where(F.length(word) >= 3).withColumn("_g", pick)
    met = long.join(grams, ["_g", *(on or [])]).where(F.contains(text, word)).drop("_g")
    if on is None:
        return met
    # A short word has no trigram of its own; within equal columns its rows are compared directly.
    short = words.where(F.length(word) < 3).join(texts, on).where(F.contains(text, word))
    return met.unionByName(short.select(*met.columns))


def total(name_similarity: Column, overlap: Column, species_hit: Column, substance_hit: Column) -> Column:
    """The score of a pair."""
    return WEIGHTS["name"] * name_similarity + WEIGHTS["tokens"] * overlap + WEIGHTS["species"] * species_hit.cast("double") + WEIGHTS["substance"] * substance_hit.cast("double")


def rank(pairs: DataFrame, qid: str, key: str, name_similarity: Column, overlap: Column, species_hit: Column, substance_hit: Column) -> DataFrame:
    """pairs with score, rank, gap (to the next; 1.0 for a single candidate) and ambiguous."""
    w = Window.partitionBy(qid).orderBy(F.round("score", 9).desc(), key)
    scored = pairs.withColumn("score", total(name_similarity, overlap, species_hit, substance_hit)).withColumn("rank", F.row_number().over(w))
    return scored.withColumn("gap", F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(1.0))).withColumn("ambiguous", F.round("gap", 9) < AMBIGUOUS_GAP)


def species_matches(wanted: Column, listed: Column) -> Column:
    return F.coalesce(F.contains(F.lower(listed), F.lower(F.nullif(wanted, F.lit("")))), F.lit(False))


def substance_matches(wanted: Column, listed: Column) -> Column:
    """Whether the substance is part of a listed one or the reverse."""
    low = F.lower(F.nullif(wanted, F.lit("")))
    return F.coalesce(F.exists(F.filter(listed, lambda s: s.isNotNull()), lambda s: F.contains(F.lower(s), low) | F.contains(low, F.lower(s))), F.lit(False))
