"""Resumable ingestion: anti-join on a state table, or a checkpointed stream that stops when idle."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..schemas import EVENTS


def unprocessed(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the state; null keys always stay, repeats stay repeated."""
    return rows.join(state.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = EVENTS, files: int = 16) -> None:
    """Appends what ``source`` has and ``out`` hasn't; run again, it adds only new files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, by, n, total) over tumbling windows, or sliding ones. On a stream, events up to ``late``
    behind the newest still count and state older than that goes; on a table all count."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = d.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str | Column = "30 minutes", late: str = "1 hour", ts: str = "ts", by: str = "user_id", value: str = "value") -> DataFrame:
    """(by, start, end, n, total) of runs of events no further apart than ``gap``."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    out = d.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def run_stream(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what there is and stops; results of closed windows are appended as Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """``work(rows, number)`` on each batch of new rows: written before it counts as done, so that a batch is
    run again after a fault and must bear it."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Rows done, the mean time of one, and the time that ``total`` rows still need."""

    def __init__(self, total: int | None = None):
        self.total, self.done, self.began = total, 0, time.monotonic()

    def add(self, rows: int) -> None:
        self.done += rows

    def mean(self) -> float:
        return (time.monotonic() - self.began) / self.done if self.done else 0.0

    def left(self) -> float | None:
        return None if self.total is None else self.mean() * max(0, self.total - self.done)

    def onQueryStarted(self, event):
        self.began = time.monotonic()

    def onQueryProgress(self, event):
        self.add(event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
