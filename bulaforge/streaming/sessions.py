"""Structured Streaming: windowed activity with late data, session windows, and chained session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bulaforge.functions.entities import turn_features
from bulaforge.streaming.turns import Standing, follow

IDLE = "3600 seconds"
LATE = "1 hour"


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder or file as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def tumbling(events: DataFrame, ts: str, key: str, width: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) per tumbling window; works on a batch and on a stream."""
    timed = events.withColumn("ts_", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("ts_", LATE) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts_", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_windows(events: DataFrame, ts: str, user: str, idle: str = IDLE) -> DataFrame:
    """(user, session_start, session_end, n) by session windows; works on a batch and on a stream."""
    timed = events.withColumn("ts_", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("ts_", LATE) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("ts_", idle).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


STATE = "query string, head string, tail string, product string, topic string, seen int"
OUT = "session_id string, seq int, query string, rewritten string, is_followup boolean"


def chained_follow_ups(turns: DataFrame, idle_seconds: int = 3600) -> DataFrame:
    """Turns(session_id, seq, text) as a stream → each with its rewritten question.

    The rewritten question becomes the state the next turn is read against, which no lag
    can express; what a turn says by itself is computed in columns before the keyed step.
    State idle for longer than `idle_seconds` of processing time is dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = Standing(*state.get) if state.exists else Standing()
        rows = pd.concat(list(batches)).sort_values("seq").astype(object)
        rows = rows.where(rows.notna(), None)
        out = []
        for turn in rows.to_dict("records"):
            now, made = follow(now, turn)
            out.append((key[0], turn["seq"], turn["text"], made, made is not None))
        state.update(now.to_row())
        state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["session_id", "seq", "query", "rewritten", "is_followup"])

    said = turns.select("session_id", "seq", "text", turn_features(F.col("text")).alias("f")).select("session_id", "seq", "text", "f.*")
    return said.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
