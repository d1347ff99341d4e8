"""Zero curves as rows (curve_id, days, zero), and discount factors from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import discount_factor


def curve_points(nodes: DataFrame, curve: str = "curve_id") -> DataFrame:
    """(curve, points): each curve's nodes as an array of (days, logdf) in order of days, day 0 at factor 1 first.

    Nodes with negative days and repeats of a day are left out (the lowest rate stays). A curve has tens of nodes, so its
    array is small.
    """
    clean = nodes.where("days > 0").groupBy(curve, "days").agg(F.min("zero").alias("zero"))
    points = F.array_sort(F.collect_list(F.struct(F.col("days").cast("double").alias("days"), F.log(discount_factor(F.col("zero"), F.col("days"))).alias("logdf"))))
    start = F.array(F.struct(F.lit(0.0).alias("days"), F.lit(0.0).alias("logdf")))
    return clean.groupBy(curve).agg(F.concat(start, points).alias("points"))


#: Parts into which the rows of one curve are dealt.
PARTS = 64


def on_curve(rows: DataFrame, nodes: DataFrame, curve: str = "curve_id") -> DataFrame:
    """Adds points, the curve's, null for an unknown curve. Many rows share few curves: they are dealt by a hash of the row as well, and every part gets the curves."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(PARTS)).cast("int")
    points = curve_points(nodes, curve).withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_dealt", part).join(points, [curve, "_dealt"], "left").drop("_dealt")


def factor_at(points: Column, days: Column) -> Column:
    """Discount factor, log-linear between nodes, the outer slopes carried on beyond them."""
    d = days.cast("double")
    n = F.size(points)
    below = F.size(F.filter(points, lambda p: p["days"] <= d))
    i = F.greatest(F.lit(1), F.least(below, n - 1))
    a, b = F.element_at(points, i), F.element_at(points, F.least(i + 1, n))
    slope = F.when(b["days"] > a["days"], (b["logdf"] - a["logdf"]) / (b["days"] - a["days"])).otherwise(0.0)
    return F.exp(a["logdf"] + slope * (d - a["days"]))


def discounted(rows: DataFrame, nodes: DataFrame, days: str = "days", curve: str = "curve_id", name: str = "df") -> DataFrame:
    """Adds the discount factor of each row's days on its curve."""
    return on_curve(rows, nodes, curve).withColumn(name, factor_at(F.col("points"), F.col(days))).drop("points")


def bumped(nodes: DataFrame, parallel: float = 0.0, key_rates: dict[int, float] | None = None) -> DataFrame:
    """Zero rates moved by a parallel shift and by shifts at single tenors (days)."""
    shift = F.lit(parallel)
    for days, by in (key_rates or {}).items():
        shift = shift + F.when(F.col("days") == days, by).otherwise(0.0)
    return nodes.withColumn("zero", F.col("zero") + shift)


def fixings(rows: DataFrame, target, days: int = 365, time: str = "time_index") -> DataFrame:
    """Fixings of the year before target, strictly before it, with a value."""
    return rows.where((F.col(time) < F.lit(target)) & (F.col(time) >= F.lit(target) - F.expr(f"INTERVAL {days} DAYS")) & F.col("rate").isNotNull())


def bootstrap(quotes: DataFrame, curve: str = "curve_id", frequency_days: int = 182) -> DataFrame:
    """(curve, days, zero) from deposits (kind "deposit") and par swaps (kind "swap") with rows (curve, kind, days, rate).

    A deposit gives its factor directly. Par swaps pay every frequency_days; the factor at a swap's end follows from
    those before: df = (1 - r t sum df) / (1 + r t), nodes between quotes log-linear. A curve is a recursion over its tens
    of quotes, folded inside the row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("days").cast("double").alias("days"), F.col("kind").alias("kind"), F.col("rate").alias("rate"))))
    one = F.array(F.struct(F.lit(0.0).alias("days"), F.lit(0.0).alias("logdf")))
    tau = frequency_days / 360.0

    def step(acc: Column, q: Column) -> Column:
        paid = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(q["days"] / frequency_days).cast("int"))), lambda k: k * float(frequency_days)), lambda d: d < q["days"])
        known = F.aggregate(F.transform(paid, lambda d: factor_at(acc, d)), F.lit(0.0), lambda s, x: s + x)
        df = F.when(q["kind"] == "deposit", 1 / (1 + q["rate"] * q["days"] / 360)).otherwise((1 - q["rate"] * tau * known) / (1 + q["rate"] * tau))
        return F.concat(acc, F.array(F.struct(q["days"].alias("days"), F.log(df).alias("logdf"))))

    made = quotes.groupBy(curve).agg(F.aggregate(ordered, one, step).alias("points"))
    nodes = made.select(curve, F.explode(F.slice("points", F.lit(2), F.size("points"))).alias("p"))
    return nodes.select(curve, F.col("p.days").cast("int").alias("days"), ((F.exp(-F.col("p.logdf")) - 1) * 360 / F.col("p.days")).alias("zero"))
