"""Live tables: the same merge operators fed by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import KEY, TIME
from ..sources.store import PanelStore


def upsert_stream(stream: DataFrame, store: PanelStore, table: str, checkpoint: str, order: Sequence[str] = (TIME,), once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Upserts each micro-batch by key; a batch that is delivered twice changes nothing. once: takes what is there and ends."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, table, order=order)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def deduplicated(stream: DataFrame, delay: str, keys: Sequence[str] = (TIME, KEY), time: str = TIME) -> DataFrame:
    """Each key once; state older than the delay goes, and so do rows that come later than that."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(df: DataFrame, step: str, value: str, by: Sequence[str] = (), delay: str | None = None, time: str = TIME, slide: str | None = None) -> DataFrame:
    """Count, sum, least and largest value of each window; batch or, with a delay, stream."""
    source = df.withWatermark(time, delay) if delay else df
    w = F.window(time, step, slide) if slide else F.window(time, step)
    made = source.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return made.select(F.col("w.start").alias("window_start"), *by, "n", "total", "least", "most")


def sessions(df: DataFrame, gap: str, by: Sequence[str] = (KEY,), delay: str | None = None, time: str = TIME) -> DataFrame:
    """Runs of rows of a key with less than ``gap`` between neighbours; batch or, with a delay, stream."""
    source = df.withWatermark(time, delay) if delay else df
    made = source.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest(df: DataFrame, by: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """The last row of each key so far: one row of state a key. A stream of it is written in update mode."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(time)).alias("_row")).select(*by, "_row.*")
