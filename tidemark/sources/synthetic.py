"""Generated series, for demonstrations and tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME


def days(spark: SparkSession, since: datetime, until: datetime) -> DataFrame:
    """Midnights after ``since`` up to ``until``: what an update after that watermark is due."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until), F.expr("INTERVAL 1 DAY"))).alias(TIME)).where(F.col(TIME) > F.lit(since))


def _normal(seed: int, *by: str):
    """A standard normal number from a hash of the row, so that reruns agree whatever the partitioning (Box and Muller)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *by), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))


def random_daily(spark: SparkSession, since: datetime, until: datetime, seed: int = 1) -> DataFrame:
    return days(spark, since, until).withColumn("random_number", _normal(seed, TIME))


def simulated_prices(spark: SparkSession, last: DataFrame, since: datetime, until: datetime, mean: float = 0.0, deviation: float = 0.01, seed: int = 1) -> DataFrame:
    """(time_index, unique_identifier, close): lognormal steps from each identifier's last close."""
    cells = last.select(KEY, F.col("close").alias("_from")).crossJoin(F.broadcast(days(spark, since, until)))
    w = Window.partitionBy(KEY).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    step = F.exp(F.lit(mean) + F.lit(deviation) * _normal(seed, TIME, KEY))
    return cells.withColumn("_step", step).select(TIME, KEY, (F.col("_from") * F.product("_step").over(w)).alias("close"))
