"""Structural section filter with cascading fallback, decided in one pass over the rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulaforge.functions.dimensions import TOPIC_WORDS, TOPICS

FALLBACK_ROWS = 6


def tiered(rows: DataFrame, group: list[str], order: str, topic: str, number: str, title: str, body: str, exact: bool = False) -> DataFrame:
    """Adds tier: 1 rows whose number begins with a target of the topic; if a group has none, 2 its first rows with a
    word of the topic in title or body; if none, 3 all its rows. Only rows of the winning tier are kept.

    `exact` compares whole numbers, so 4.1 no longer takes 4.10."""
    targets = F.create_map(*[x for name, _, secs in TOPICS for x in (F.lit(name), F.array(*[F.lit(s.rstrip(".")) for s in secs]))])
    words = F.create_map(*[x for name, ws in TOPIC_WORDS.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in ws]))])
    none = F.array().cast("array<string>")
    wanted = F.coalesce(F.try_element_at(targets, F.col(topic)), none)
    bare = F.regexp_replace(F.coalesce(F.col(number), F.lit("")), r"\.$", "")
    hit1 = F.exists(wanted, (lambda t: bare == t) if exact else (lambda t: F.startswith(F.coalesce(F.col(number), F.lit("")), t)))
    said = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit(""))))
    hit2 = F.exists(F.coalesce(F.try_element_at(words, F.col(topic)), none), lambda w: F.contains(said, w))
    w = Window.partitionBy(*group)
    marked = rows.withColumn("hit1", hit1).withColumn("hit2", hit2)
    marked = marked.withColumn("any1", F.max("hit1").over(w)).withColumn("any2", F.max("hit2").over(w))
    nth = F.row_number().over(Window.partitionBy(*group, "hit2").orderBy(order))
    tier = F.when(F.col("any1"), F.when(F.col("hit1"), 1)).when(F.col("any2"), F.when(F.col("hit2") & (nth <= FALLBACK_ROWS), 2)).otherwise(3)
    return marked.withColumn("tier", tier).where("tier IS NOT NULL").drop("hit1", "hit2", "any1", "any2")


def hits(number: str, title: str, body: str) -> tuple[Callable[[str], Column | None], Callable[[str], Column | None]]:
    """As functions of a topic: whether a row's number begins with a target of the topic, and whether title or body hold a word of it; None where a topic has none."""
    at = F.coalesce(F.col(number), F.lit(""))
    said = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit(""))))
    targets = {name: [F.startswith(at, F.lit(s.rstrip("."))) for s in secs] for name, _, secs in TOPICS}
    words = {name: [F.contains(said, F.lit(w)) for w in ws] for name, ws in TOPIC_WORDS.items()}

    def any_of(found: dict[str, list[Column]]) -> Callable[[str], Column | None]:
        return lambda topic: functools.reduce(lambda a, b: a | b, found[topic]) if found.get(topic) else None

    return any_of(targets), any_of(words)
