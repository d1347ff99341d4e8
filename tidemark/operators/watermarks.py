"""Per-key watermarks: what is stored already, and what is new."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, TIME


def watermarks(df: DataFrame, keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """Earliest and latest time of every key."""
    return df.groupBy(*keys).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def span(stats: DataFrame, entities: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Earliest and latest time of all, or of the entities asked for."""
    stats = stats if entities is None else stats.join(entities.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    return stats.agg(F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"))


def newer(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (KEY,), time: str = TIME, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Rows after their key's watermark and rows of keys without one; of repeated keys the first by ``order``, or by their values.

    Without keys (a table by time alone) rows at the watermark stay, as they may still be complete.
    """
    if not keys:
        top = stats.agg(F.max("max_time").alias("_max"))
        return df.join(F.broadcast(top), F.col("_max").isNull() | (F.col(time) >= F.col("_max"))).drop("_max")
    marks = stats.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("max_time").alias("_max"))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = df.join(marks, cond, "left").where(F.col("_max").isNull() | (F.col(time) > F.col("_max"))).select(*df.columns)
    from .merge import keep_one

    if order is None:
        order = [F.struct(*(c for c in df.columns if c not in (time, *keys)))] if set(df.columns) - {time, *keys} else [time]

    return keep_one(out, order, [time, *keys], last=False)


def scoped(stats: DataFrame, entities: DataFrame, fallback: datetime, key: str = KEY) -> DataFrame:
    """(key, max_time) of the entities asked for: latest over nested keys, or the fallback."""
    last = stats.groupBy(F.col(key).alias("_k")).agg(F.max("max_time").alias("_max"))
    return entities.select(key).join(last, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_max", F.lit(fallback)).alias("max_time"))


def ranges_since(stats: DataFrame, fallback: datetime, delta: str | None = None, key: str = KEY) -> DataFrame:
    """Ranges that start at each key's watermark, plus ``delta`` (an interval as SQL text), and have no end."""
    start = F.coalesce("max_time", F.lit(fallback))
    if delta:
        start = start + F.expr(f"INTERVAL {delta}")
    return stats.select(F.col(key).alias("range_key"), start.alias("range_start"), F.lit(False).alias("start_open"), F.lit(None).cast(stats.schema["max_time"].dataType).alias("range_end"), F.lit(False).alias("end_open"))


def pruned(stats: DataFrame, wanted: DataFrame, fallback: datetime) -> DataFrame:
    """For every combination of keys in wanted its max_time, or the fallback."""
    keys = wanted.columns
    marks = stats.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("max_time").alias("_max"))
    return wanted.join(marks, [F.col(k) == F.col(f"_{k}") for k in keys], "left").select(*keys, F.coalesce("_max", F.lit(fallback)).alias("max_time"))


def earliest(stats: DataFrame, fallback: datetime, key: str = KEY) -> DataFrame:
    """The least watermark among a key's nested keys."""
    return stats.groupBy(key).agg(F.coalesce(F.min("max_time"), F.lit(fallback)).alias("max_time"))


def next_query(stats: DataFrame, now: datetime, step: str) -> DataFrame:
    """When to ask for more: null within one step of now, else 5 ms after the watermark."""
    recent = F.lit(now) - F.col("max_time") < F.expr(f"INTERVAL {step}")
    return stats.withColumn("next_query", F.when(~recent, F.col("max_time") + F.expr("INTERVAL 5 MILLISECONDS")))


def last_rows(df: DataFrame, keys: Sequence[str] = (KEY,), time: str = TIME, tie: Sequence[str] = ()) -> DataFrame:
    """The last row of every key; ties in time go by further columns. Pre-aggregated before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*(F.col(c) for c in (time, *tie)))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def column_watermarks(df: DataFrame, columns: Sequence[str], key: str = KEY, time: str = TIME) -> DataFrame:
    """Latest time with a value, by key and column."""
    made = df.groupBy(key).agg(*(F.max(F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns))
    return made.unpivot([key], list(columns), "column_name", "max_time")


def update_window(*dependencies: DataFrame) -> DataFrame:
    """(window_start, window_end) of one row: up to the earliest of the latest times of all identifiers of all dependencies.

    dependencies are watermarks; what lies beyond the end isn't known for all of them yet.
    """
    every = dependencies[0].select("min_time", "max_time")
    for d in dependencies[1:]:
        every = every.unionByName(d.select("min_time", "max_time"))
    return every.agg(F.min("min_time").alias("window_start"), F.min("max_time").alias("window_end"))
