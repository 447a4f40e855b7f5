"""Change events in event time: windows, sessions and the last state of a path. Each works on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` of windows side by side; on a stream events later than ``late`` are dropped."""
    source = _timed(events, late)
    return source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "30 minutes", late: str | None = None) -> DataFrame:
    """The same in windows that overlap."""
    source = _timed(events, late)
    return source.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def debounced(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``key, first_ts, last_ts, n``: bursts of a key's events; each event within the gap prolongs its burst."""
    source = _timed(events, late)
    sessions = source.groupBy(F.session_window("ts", gap).alias("w"), key)
    return sessions.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).select(key, "first_ts", "last_ts", "n")


def last_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """``key, event_type, ts``: the last event of each key; of events at one time that with the greatest id."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("l")
    return events.groupBy(key).agg(last).select(key, "l.event_type", "l.ts")


def with_retries(attempts: DataFrame, most: int = 3, key: str = "path") -> DataFrame:
    """``key, attempts, outcome``: what becomes of a path that is tried at most ``most`` times.

    ``attempts`` has ``key, seq, ok``. The first success ends it (``done``); after ``most`` failures it is given up
    (``dropped``); otherwise it is tried again (``pending``).
    """
    numbered = attempts.withColumn("_n", F.row_number().over(_by(key)))
    tried = numbered.filter(F.col("_n") <= most)
    done = F.min(F.when(F.col("ok"), F.col("_n")))
    out = tried.groupBy(key).agg(F.count(F.lit(1)).alias("_c"), done.alias("_done"))
    return out.select(
        key,
        F.coalesce("_done", "_c").cast("long").alias("attempts"),
        F.when(F.col("_done").isNotNull(), "done").when(F.col("_c") >= most, "dropped").otherwise("pending").alias("outcome"),
    )


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("seq")
