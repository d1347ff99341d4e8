"""Sources that come as files: external prices and weights, portfolios, fixings, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import map_keys
from ..operators.watermarks import newer
from ..schema import KEY, TIME

MAPS = ("rebalance_weights", "rebalance_price", "volume", "weights_at_last_rebalance", "price_at_last_rebalance", "volume_at_last_rebalance")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; the schema is given, so that no pass is spent on guessing it. A malformed row raises."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def external_prices(spark: SparkSession, path: str, entities: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """(time_index, unique_identifier, open) from rows time_index, figi, price; entities maps figi to unique_identifier."""
    rows = read_csv(spark, path, f"{TIME} timestamp, figi string, price double").withColumnRenamed("figi", KEY)
    rows = map_keys(rows, entities, "figi", KEY).select(TIME, KEY, F.col("price").alias("open"))
    return rows if since is None else newer(rows, since)


def external_weights(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """(time_index, unique_identifier, signal_weight) from rows time_index, figi, weight, price."""
    rows = external_portfolio(spark, path).withColumnRenamed("figi", KEY)
    return map_keys(rows, entities, "figi", KEY).select(TIME, KEY, F.col("weight").alias("signal_weight"))


def external_portfolio(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a portfolio file, whose columns must be exactly time_index, figi, weight, price."""
    want = {TIME: "timestamp", "figi": "string", "weight": "double", "price": "double"}
    found = spark.read.option("header", True).csv(path).columns
    if set(found) != set(want):
        raise ValueError(f"columns must be {sorted(want)}, not {sorted(found)}")
    return read_csv(spark, path, ", ".join(f"{c} {want[c]}" for c in found))


def portfolio_rows(df: DataFrame, since=None, extra: Sequence[str] = ()) -> DataFrame:
    """A portfolio table from any frame: known columns only, rows at or after ``since``, map columns as JSON texts."""
    known = [TIME, "close", "return", "last_rebalance_date", "close_time", *MAPS, *extra]
    kinds = dict(df.dtypes)
    out = df.select(*(F.to_json(c).alias(c) if kinds[c].startswith(("map", "struct")) else F.col(c) for c in known if c in kinds))
    return out if since is None else out.where(F.col(TIME) >= F.lit(since))


def json_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nested columns as JSON texts, for sinks without nested types."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def fixings_csv(spark: SparkSession, path: str, end=None) -> DataFrame:
    """(fixing_date, rate) from rows date (MM/dd/yyyy), rate in percent; asking for more than the file holds raises."""
    rows = read_csv(spark, path, "date string, rate double").select(F.to_date("date", "MM/dd/yyyy").alias("fixing_date"), (F.col("rate") / 100).alias("rate"))
    if end is None:
        return rows
    last = rows.agg(F.max("fixing_date")).first()[0]
    if last is None or end > last:
        raise ValueError(f"fixings end at {last}")
    return rows.where(F.col("fixing_date") <= F.lit(end))


def curve_csv(spark: SparkSession, path: str, curve: str) -> DataFrame:
    """(curve_id, days, zero) from headerless rows date (yyMMdd), rate in percent; days count from the earliest date."""
    rows = spark.read.schema("date string, rate double").csv(path).select(F.to_date("date", "yyMMdd").alias("d"), (F.col("rate") / 100).alias("zero"))
    first = rows.agg(F.min("d")).first()[0]
    return rows.select(F.lit(curve).alias("curve_id"), F.datediff("d", F.lit(first)).alias("days"), "zero")
