"""Positions: rollups of prices, cashflows and greeks over instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net_cashflows(cashflows: DataFrame, positions: DataFrame) -> DataFrame:
    """(payment_date, amount) over all instruments, in units held."""
    return cashflows.join(positions.select("ins_id", "units"), "ins_id").groupBy("payment_date").agg(F.sum(F.col("amount") * F.col("units")).alias("amount"))


def cashflows_by_leg(cashflows: DataFrame, positions: DataFrame, today: Column) -> DataFrame:
    """(leg, payment_date, amount); flows without a date fall on today."""
    rows = cashflows.join(positions.select("ins_id", "units"), "ins_id")
    return rows.groupBy("leg", F.coalesce("payment_date", today).alias("payment_date")).agg(F.sum(F.col("amount") * F.col("units")).alias("amount"))


def carry(cashflows: DataFrame, positions: DataFrame, valuation: Column, cutoff: Column) -> DataFrame:
    """Sum of the flows after the valuation date up to the cutoff, one row."""
    inside = (F.col("payment_date") > valuation) & (F.col("payment_date") <= cutoff)
    rows = cashflows.join(positions.select("ins_id", "units"), "ins_id")
    return rows.agg(F.coalesce(F.sum(F.when(inside, F.col("amount") * F.col("units"))), F.lit(0.0)).alias("carry"))


def npv_table(base: DataFrame, bumped: DataFrame, positions: DataFrame) -> DataFrame:
    """(ins_id, base, bumped, delta) in units held, and a row TOTAL. delta needs both values finite."""
    rows = positions.select("ins_id", "units").join(base.select("ins_id", F.col("npv").alias("b")), "ins_id", "left").join(bumped.select("ins_id", F.col("npv").alias("u")), "ins_id", "left")
    rows = rows.select("ins_id", (F.col("b") * F.col("units")).alias("base"), (F.col("u") * F.col("units")).alias("bumped"))
    out = rows.rollup("ins_id").agg(F.sum("base").alias("base"), F.sum("bumped").alias("bumped"))
    return out.select(F.coalesce("ins_id", F.lit("TOTAL")).alias("ins_id"), "base", "bumped", (F.col("bumped") - F.col("base")).alias("delta"))


def greeks(rows: DataFrame, positions: DataFrame, column: str = "greeks") -> DataFrame:
    """(name, value): maps of greeks summed over instruments in units held."""
    e = rows.join(positions.select("ins_id", "units"), "ins_id").select("units", F.explode(column).alias("name", "v"))
    return e.groupBy("name").agg(F.sum(F.col("v") * F.col("units")).alias("value"))


def price_breakdown(prices: DataFrame, positions: DataFrame) -> DataFrame:
    """(ins_id, units, price, value) for each position."""
    return positions.select("ins_id", "units").join(prices.select("ins_id", "price"), "ins_id", "left").withColumn("value", F.col("units") * F.col("price"))


def with_curve(instruments: DataFrame, ins_ids: Column, curve: str) -> DataFrame:
    """Moves the instruments for which ins_ids holds to another curve; they are priced on it when next joined."""
    return instruments.withColumn("curve_id", F.when(ins_ids, F.lit(curve)).otherwise(F.col("curve_id")))
