"""Question files: one question per line, noise lines left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def questions(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """lines → (text). Strict: lines that end in a question mark and begin with none of | # // --.
    Lenient: non-blank lines that begin with none of | - # and don't end in a dash."""
    text = F.trim(F.col(column))
    if strict:
        keep = F.endswith(text, F.lit("?")) & ~text.rlike(r"^(?:\||#|//|--)")
    else:
        keep = (text != "") & ~text.rlike(r"^[|\-#]") & ~F.endswith(text, F.lit("-")) & ~F.lower(text).rlike("^perguntas")
    return lines.select(text.alias("text")).where(keep)


def load(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return questions(spark.read.text(path), "value", strict)
