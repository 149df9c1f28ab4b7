"""Dose mentions in leaflet sections, with their context and a species guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of the context, pattern of a dose per weight.
CONTEXT_CHARS = 80
MENTION = r"(?iu)\d+[.,]?\d*\s*(?:mg|mcg|µg|ml)\s*/\s*kg"


def display(value: Column, unit: Column) -> Column:
    return F.concat(F.replace(value, F.lit(","), F.lit(".")), F.lit(" "), unit, F.lit("/kg"))


def names(species: Column) -> Column:
    """Whether the context or section of a mention names the species."""
    return F.contains(F.lower("contexto"), F.lower(species)) | F.contains(F.lower("body_"), F.lower(species))


def mentions(sections: DataFrame, keys: list[str], order: list[str], body: str) -> DataFrame:
    """(keys…, order…, i_, m_, body_, contexto, …): every mention of a dose.

    Places are found by cutting the body at its mentions, so no offsets are needed: the
    context is the end of what stands before and the beginning of what follows."""
    text = F.coalesce(F.col(body), F.lit(""))
    cut = sections.select(*keys, *order, text.alias("body_"), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)).alias("ms_"), F.split(text, MENTION).alias("gaps_"))
    each = cut.select(*keys, *order, "body_", "ms_", "gaps_", F.posexplode("ms_").alias("i_", "m_"))
    weave = F.zip_with(F.col("gaps_"), F.col("ms_"), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    before = F.concat(F.array_join(F.slice(weave, F.lit(1), F.col("i_")), ""), F.get("gaps_", F.col("i_")))
    at = F.length(before)
    window = F.substring("body_", F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)) + F.length("m_") + CONTEXT_CHARS)
    found = each.withColumn("contexto", F.translate(window, "\n", " "))
    part = r"(?iu)^(\d+[.,]?\d*)\s*(mg|mcg|µg|ml)"
    found = found.withColumn("valor", F.regexp_extract("m_", part, 1)).withColumn("unidade", F.replace(F.lower(F.regexp_extract("m_", part, 2)), F.lit("µg"), F.lit("mcg")))
    return found.withColumn("display", display(F.col("valor"), F.col("unidade")))


def extract(sections: DataFrame, keys: list[str], order: list[str], body: str, species: Column | None = None) -> DataFrame:
    """(keys…, ord, valor, unidade, contexto, display): every distinct dose per key, in order of first mention."""
    found = mentions(sections, keys, order, body)
    if species is not None:
        found = found.where(species.isNull() | names(species))
    found = found.withColumn("at_", F.struct(*order, "i_"))
    first = found.groupBy(*keys, "display").agg(F.min_by(F.struct("valor", "unidade", "contexto"), "at_").alias("found_"), F.min("at_").alias("at_"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at_"))
    return first.select(*keys, nth.alias("ord"), "found_.valor", "found_.unidade", "found_.contexto", "display")
