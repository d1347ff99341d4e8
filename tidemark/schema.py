"""The panel model: rows keyed by (time_index, unique_identifier), and the checks on ingest.

Time is kept in UTC microseconds; missing values are null, never NaN or infinity.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME, KEY = "time_index", "unique_identifier"


def by_key(*keys: str, time: str = TIME) -> WindowSpec:
    """Rows of a key in time order."""
    return Window.partitionBy(*(keys or (KEY,))).orderBy(time)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normalize(df: DataFrame, keys: tuple[str, ...] = (TIME, KEY)) -> DataFrame:
    """NaN and infinities become null, decimals doubles, a missing identifier the empty text; identifiers are text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        if f.name in keys and f.name != keys[0]:
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif f.name == keys[0] and isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def coerce_timestamp(c: Column, kind: T.DataType) -> Column:
    """Timestamps from whole numbers, whose unit follows from their size (ns, us, ms, else s), and from ISO texts; naive is UTC."""
    if isinstance(kind, T.IntegralType):
        x, size = c.cast("long"), F.abs(c.cast("long"))
        micros = F.when(size > 10**17, F.floor(x / 1000)).when(size > 10**14, x).when(size > 10**11, x * 1000).otherwise(x * 1_000_000)
        return F.timestamp_micros(micros.cast("long"))
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(c)
    return c.cast("timestamp")


def validate_update(df: DataFrame, keys: tuple[str, ...] = (TIME, KEY), allow_times: bool = True) -> DataFrame:
    """Raises on a missing key, a key that is no timestamp, or an upper-case name; infinities become null."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    if not isinstance(df.schema[keys[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{keys[0]} must be a timestamp")
    loud = [c for c in df.columns if c != c.lower()]
    if loud:
        raise ValueError(f"column names must be lower case: {loud}")
    if not allow_times:
        times = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        if times:
            raise TypeError(f"time columns must be stored as epochs: {times}")
    return normalize(df, keys)


def duplicated(df: DataFrame, keys: tuple[str, ...] = (TIME, KEY)) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reject_duplicates(df: DataFrame, keys: tuple[str, ...] = (TIME, KEY)) -> DataFrame:
    """The rows, or an error that names a repeated key."""
    one = duplicated(df, keys).limit(1).collect()
    if one:
        raise ValueError(f"repeated key: {one[0].asDict()}")
    return df


def restore_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Casts the named columns to their stored types; others stay."""
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def epoch_ns(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) * 1000
