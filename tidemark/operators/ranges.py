"""Reads by time, identifier and per-identifier ranges."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, TIME

#: Ranges and id lists up to so many rows are broadcast; beyond, Spark shuffles or decides by size.
BROADCAST_ROWS = 100_000
#: Id lists up to this length become an IN filter that reaches the scan.
PUSHED_IDS = 1_000


@dataclass(frozen=True)
class Range:
    start: datetime | None = None
    end: datetime | None = None
    start_operand: str = ">="
    end_operand: str = "<="

    def __post_init__(self):
        if self.start_operand not in (">", ">=") or self.end_operand not in ("<", "<="):
            raise ValueError("operands are > or >= and < or <=")


def range_table(spark: SparkSession, ranges: Mapping[str, Range], time_type: str = "timestamp") -> DataFrame:
    """(key, start, start_open, end, end_open), one row for each identifier."""
    rows = [(k, r.start, r.start_operand == ">", r.end, r.end_operand == "<") for k, r in ranges.items()]
    made = spark.createDataFrame(rows, f"range_key string, range_start {time_type}, start_open boolean, range_end {time_type}, end_open boolean")
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def within(t: Column, start: Column, start_open: Column, end: Column, end_open: Column) -> Column:
    """t lies in a range whose ends may be open or missing."""
    after = start.isNull() | (t > start) | (~start_open & (t == start))
    return after & (end.isNull() | (t < end) | (~end_open & (t == end)))


def range_filter(df: DataFrame, ranges: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Rows inside a range of their identifier; an identifier without a range has no rows. Semi join: no row twice."""
    inside = within(F.col(time), F.col("range_start"), F.col("start_open"), F.col("range_end"), F.col("end_open"))
    return df.join(ranges, (F.col(key) == F.col("range_key")) & inside, "left_semi")


def range_read(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None, great_or_equal: bool = True, less_or_equal: bool = True,
    ids: Iterable[str] | DataFrame | None = None, columns: Iterable[str] | None = None, ranges: DataFrame | Mapping[str, Range] | None = None,
    combine: str = "override", on_missing: str = "raise", ordered: bool = False, key: str = KEY, time: str = TIME,
) -> DataFrame:
    """A panel cut by time bounds, identifiers and ranges; key columns are always part of the result.

    ranges overrides the other row filters (combine="override") or is added to them ("and"). A column that the panel
    doesn't have is an error, or with on_missing="empty" an empty result. ids and ranges together are an error. Ranges
    given as a mapping also bound the scan: by their earliest start and latest end where all have one, and by their ids.
    """
    if ids is not None and ranges is not None:
        raise ValueError("ids and ranges exclude each other")
    if columns is not None:
        wanted = [time] + [k for k in [key] if k in df.columns] + [c for c in columns if c not in (time, key)]
        missing = [c for c in wanted if c not in df.columns]
        if missing and on_missing != "empty":
            raise ValueError(f"no such columns: {missing}")
        df = df.select(*(c for c in wanted if c in df.columns)).where(F.lit(not missing))
    if ranges is None or combine == "and":
        t = F.col(time)
        if start is not None:
            df = df.where(t >= F.lit(start) if great_or_equal else t > F.lit(start))
        if end is not None:
            df = df.where(t <= F.lit(end) if less_or_equal else t < F.lit(end))
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(key) == F.col("_id"), "left_semi")
    elif ids is not None:
        ids = [str(i) for i in ids]
        if len(ids) <= PUSHED_IDS:
            df = df.where(F.col(key).isin(ids))
        else:
            listed = df.sparkSession.createDataFrame([(i,) for i in ids], "_id string")
            df = df.join(F.broadcast(listed) if len(ids) <= BROADCAST_ROWS else listed, F.col(key) == F.col("_id"), "left_semi")
    if isinstance(ranges, Mapping):
        if ranges and all(r.start is not None for r in ranges.values()):
            df = df.where(F.col(time) >= F.lit(min(r.start for r in ranges.values())))
        if ranges and all(r.end is not None for r in ranges.values()):
            df = df.where(F.col(time) <= F.lit(max(r.end for r in ranges.values())))
        if len(ranges) <= PUSHED_IDS:
            df = df.where(F.col(key).isin(list(ranges)))
        ranges = range_table(df.sparkSession, ranges, df.schema[time].dataType.simpleString())
    if ranges is not None:
        df = range_filter(df, ranges, key, time)
    return df.orderBy(time) if ordered else df


def time_minima(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Earliest time of all (is_total) and of each identifier, in one pass of grouping sets."""
    return df.groupingSets([[], [F.col(key)]], F.col(key)).agg(F.min(time).alias("min_time"), (F.grouping(key) == 1).alias("is_total"))


def entity_filter(security_type: str | None = None, sector: str | None = None) -> Column:
    """Equality on both attributes; None matches all."""
    cond = F.lit(True)
    for name, value in (("security_type", security_type), ("sector", sector)):
        if value is not None:
            cond = cond & F.col(name).eqNullSafe(F.lit(value))
    return cond


def ever_above(df: DataFrame, value: str, least: float = 0.01, key: str = KEY) -> DataFrame:
    """Rows of the identifiers whose value exceeds ``least`` at some time."""
    keep = df.groupBy(key).agg(F.max(value).alias("_most")).where(F.col("_most") > least).select(F.col(key).alias("_keep"))
    return df.join(keep, F.col(key) == F.col("_keep"), "left_semi")


def distinct_ids(df: DataFrame, key: str = KEY) -> DataFrame:
    """The identifiers that have rows."""
    return df.select(key).distinct()


def missing_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column_name, n_missing, n): missing values of each column, in one pass."""
    columns = list(columns)
    made = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)))
    return made.select(F.explode(pairs).alias("p"), "n").select("p.*", "n")


def require_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The rows, or an error that names the columns with missing values."""
    bad = missing_values(df, columns).where("n_missing > 0").collect()
    if bad:
        raise ValueError("missing values: " + ", ".join(f"{r.column_name} ({r.n_missing} of {r.n})" for r in bad))
    return df
