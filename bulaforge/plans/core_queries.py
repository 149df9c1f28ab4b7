"""Queries of the general data problems (packed fields, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulaforge.operators.packed_fields import explode_packed
from bulaforge.operators.units import per_kilogram, unmatched_spellings
from bulaforge.sources.tables import once_per_key, table


def listing_values(spark: SparkSession, base: str) -> DataFrame:
    """All values of the packed listing fields, one row per listing, field and position."""
    rows = once_per_key(table(spark, base, "listings", ["listing_id", "visible_text", "species", "substances", "ingested_at"]), "listing_id")
    return explode_packed(rows, ["listing_id"], {"visible_text": "labelled", "species": "list", "substances": "list"})


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return listing_values(spark, base)


def p1_value_counts(spark: SparkSession, base: str) -> DataFrame:
    """How many listings hold how many values, by field."""
    per_field = listing_values(spark, base).groupBy("listing_id", "fld").agg(F.max("pos").alias("n_values"))
    return per_field.groupBy("fld", "n_values").agg(F.count("*").alias("n_listings"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return per_kilogram(table(spark, base, "doses", ["dose_id", "valor", "unidade", "contexto"]), "dose_id", "valor", "unidade", "contexto")


def p6_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """The spellings at a unit's place that mean no known unit, with how many doses have them."""
    return unmatched_spellings(table(spark, base, "doses", ["dose_id", "valor", "unidade", "contexto"]), "dose_id", "valor", "unidade", "contexto")


QUERIES = {"p1_found": p1_found, "p1_value_counts": p1_value_counts, "p6_found": p6_found, "p6_unmatched": p6_unmatched}
