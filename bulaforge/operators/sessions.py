"""Sessions in batch: gaps, last turns, previous turn; chained follow-ups as a keyed fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS, HISTORY, RESPONSE_CHARS = 3600, 8, 200


def gap_sessions(events: DataFrame, user: str, ts: str, tie: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """Adds session_no per user: a new session begins after more than `idle` seconds without an event."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    fresh = F.when(pause > idle * 1_000_000, 1).otherwise(0)
    return events.withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1).drop("fresh")


def last_turns(turns: DataFrame, session: str, order: list[str], response: str, keep: int = HISTORY) -> DataFrame:
    """The last turns of each session, responses cut to RESPONSE_CHARS characters."""
    w = Window.partitionBy(session).orderBy(*[F.col(c).desc() for c in order])
    cut = F.when(F.length(response) > RESPONSE_CHARS, F.concat(F.substring(response, 1, RESPONSE_CHARS), F.lit("..."))).otherwise(F.col(response))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep).withColumn(response, cut)


def previous_turn(turns: DataFrame, session: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds last_<column> of the turn before in the same session."""
    w = Window.partitionBy(session).orderBy(*order)
    return turns.withColumns({f"last_{c}": F.lag(c).over(w) for c in columns})


def longest_gap_history(events: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """(user, sessions, events, longest_session) per user."""
    s = gap_sessions(events, user, ts, tie).groupBy(user, "session_no").agg(F.count("*").alias("n"))
    return s.groupBy(user).agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest_session"))


def fold_in_order(turns: DataFrame, session: str, order: list[str], begin, step, schema: str) -> DataFrame:
    """The turns of each session in order through `step(state, row) -> (state, out row)` from the state `begin`; for chained state only, where lag can't serve.

    Rows stream past sorted by session, so a session of any length costs one state and no group in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, begin
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if row[session] != current:
                    current, state = row[session], begin
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return turns.repartition(session).sortWithinPartitions(session, *order).mapInPandas(run, schema)
