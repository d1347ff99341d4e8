"""Dedup, upsert and alignment by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME

KEYS = (TIME, KEY)

#: Rows that a task sorts or groups by key, about.
TASK_ROWS = 400_000


def dealt(df: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows dealt by key to so many tasks that each has about TASK_ROWS of ``rows``, whatever the size and the session's partitions.

    A filter of the result is dealt before the shuffle. Of a Parquet table count() reads footers only.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def keep_one(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = KEYS, last: bool = True, colocate: Sequence[str] | None = None) -> DataFrame:
    """The last (or first) row of each key by an explicit order: Spark has no row order of its own.

    colocate: a part of the key by which later windows partition. Rows are then shuffled by it once, and what follows by
    it in time order needs neither a shuffle nor a sort of its own. Without it a hot entity is spread over its times.
    """
    by = [(c if isinstance(c, Column) else F.col(c)) for c in order]
    # the time comes last, so that the sort also serves windows by the other keys in time order
    parts = [k for k in keys if k != TIME] + [k for k in keys if k == TIME]
    w = Window.partitionBy(*parts).orderBy(*(c.desc() if last else c.asc() for c in by))
    if colocate:
        df = df.repartition(*colocate)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Incoming rows whose key isn't there yet."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def overlap_exists(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> bool:
    """Whether any key is in both; stops at the first."""
    return not incoming.select(*keys).join(existing.select(*keys), list(keys), "left_semi").limit(1).isEmpty()


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS, mode: str = "coalesce") -> DataFrame:
    """Both sides' rows by key; one row a key is assumed on either side.

    mode "coalesce": an incoming null never erases a value; "replace": an incoming row replaces the whole row. Columns
    are the union of both sides.
    """
    keys = list(keys)
    columns = existing.columns + [c for c in incoming.columns if c not in existing.columns]
    if mode == "replace":
        kept = existing.join(incoming.select(*keys), keys, "left_anti")
        return kept.unionByName(incoming, allowMissingColumns=True).select(*columns)
    if mode != "coalesce":
        raise ValueError(mode)
    old = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in existing.columns if c not in keys))
    new = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in keys))
    both = new.join(old, keys, "full_outer")
    value = lambda c: F.coalesce(*(F.col(f"_{s}_{c}") for s, side in (("new", incoming), ("old", existing)) if c in side.columns))
    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in columns))


def combine_first(first: DataFrame, second: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Values of first where it has any, else of second; all keys of both."""
    return upsert(second, first, keys)


def align(sides: dict[str, DataFrame], value: str, keys: Sequence[str] = KEYS, fill: float | None = None) -> DataFrame:
    """The value of several frames side by side on the union of their keys: one shuffle, no chain of joins."""
    tagged = [df.select(*keys, F.lit(name).alias("_side"), F.col(value).alias("_value")) for name, df in sides.items()]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    made = [F.max(F.when(F.col("_side") == name, F.col("_value"))).alias(name) for name in sides]
    out = every.groupBy(*keys).agg(*made)
    return out.fillna(fill, list(sides)) if fill is not None else out


def replace_span(existing: DataFrame, incoming: DataFrame, key: str | None = KEY, time: str = TIME) -> DataFrame:
    """Deletes what exists in [min, max] of the incoming times, by identifier or in all, and adds the incoming rows."""
    spans = incoming.groupBy(*([F.col(key).alias("_k")] if key else [])).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    hit = F.col(time).between(F.col("_lo"), F.col("_hi"))
    kept = existing.join(spans, (F.col(key) == F.col("_k")) & hit, "left_anti") if key else existing.join(F.broadcast(spans), hit, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by name, repeats once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct()


def time_grid(*frames: DataFrame, time: str = TIME) -> DataFrame:
    """All times that any frame has."""
    return union_distinct(*(f.select(time) for f in frames))


def names_only_left(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    return left.select(name).subtract(right.select(name))


def map_keys(df: DataFrame, mapping: DataFrame, source: str, target: str, how: str = "inner", key: str = KEY) -> DataFrame:
    """Replaces the identifier by the target column of a mapping, whose source values are unique."""
    m = mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    out = df.join(m, F.col(key) == F.col("_from"), how)
    return out.withColumn(key, F.col("_to")).drop("_from", "_to")
