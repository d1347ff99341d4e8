"""Long and wide forms, maps and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, TIME


def to_wide(df: DataFrame, value: str, entities: Sequence[str], key: str = KEY, time: str = TIME) -> DataFrame:
    """Mean of the value by time, a column for each of the named entities. For a matrix at the edge only."""
    return df.groupBy(time).pivot(key, list(entities)).agg(F.avg(value))


def to_long(df: DataFrame, columns: Sequence[str], value: str = "value", key: str = KEY, ids: Sequence[str] = (TIME,), drop_null: bool = True) -> DataFrame:
    out = df.unpivot(list(ids), list(columns), key, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def to_map(df: DataFrame, value: str, by: Sequence[str] = (TIME,), key: str = KEY, as_json: bool = False) -> DataFrame:
    """One map entity -> value for each time, entries in order of the entity; nulls left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v")))))
    made = F.map_from_entries(pairs)
    return df.groupBy(*by).agg((F.to_json(made) if as_json else made).alias(value))


def from_map(df: DataFrame, column: str, value: str = "value", key: str = KEY, is_json: bool = False) -> DataFrame:
    source = F.from_json(column, "map<string,double>") if is_json else F.col(column)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(source).alias(key, value))


def flatten_positions(df: DataFrame, column: str = "holdings") -> DataFrame:
    """A row for each element of an array of structs."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias("_p")).select(*rest, "_p.*")


def head_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first n rows of each group in a total order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_words(text, n: int):
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs of columns as rows: one aggregation of one row."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def latest_common(df: DataFrame, period: str = "quarter", key: str = KEY) -> DataFrame:
    """The latest period that every entity has reached."""
    return df.groupBy(key).agg(F.max(period).alias("_m")).agg(F.min("_m").alias(period))
