"""Curves whose log discount factors are natural cubic splines, built from par quotes all at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SOLVED = T.StructType([T.StructField("logdf", T.ArrayType(T.DoubleType())), T.StructField("bend", T.ArrayType(T.DoubleType()))])
_ONE = 360.0


def bends(days: np.ndarray) -> np.ndarray:
    """(n + 1, n): second derivatives at 0 and the days, from log factors at the days (0 at day 0). The ends don't bend.

    They are linear in the values, so that one matrix serves all curves quoted on the same days.
    """
    t = np.concatenate([[0.0], days])
    h, n = np.diff(t), len(days)
    out = np.zeros((n + 1, n + 1))
    if n > 1:
        left, right = np.zeros((n - 1, n - 1)), np.zeros((n - 1, n + 1))
        for i in range(n - 1):
            left[i, i] = (h[i] + h[i + 1]) / 3
            if i:
                left[i, i - 1] = left[i - 1, i] = h[i] / 6
            right[i, i], right[i, i + 1], right[i, i + 2] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        out[1:n] = np.linalg.solve(left, right)
    return out[:, 1:]


def weights(days: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(len(at), n): log factors at 0 < at <= days[-1] as sums of those at the days."""
    t = np.concatenate([[0.0], days])
    m, values = bends(days), np.eye(len(t))[:, 1:]
    i = np.clip(np.searchsorted(t, at, side="left") - 1, 0, len(days) - 1)
    h = t[i + 1] - t[i]
    a = ((t[i + 1] - at) / h)[:, None]
    b = 1 - a
    return a * values[i] + b * values[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * (h**2)[:, None] / 6


def solve(days: np.ndarray, swap: np.ndarray, rates: np.ndarray, every: int) -> np.ndarray:
    """(curves, n) log factors at which each of the curves' quotes, all on the same days, is at par; NaN where Newton's steps don't settle."""
    n = len(days)
    dates = [np.append(np.arange(every, d, every, dtype=float), d) if s else np.array([d]) for d, s in zip(days, swap, strict=True)]
    w = weights(days, np.concatenate(dates))
    quote = np.repeat(np.arange(n), [len(d) for d in dates])
    tau = np.concatenate([np.diff(d, prepend=0.0) for d in dates]) / _ONE
    sums = np.zeros((n, len(quote)))
    sums[quote, np.arange(len(quote))] = tau
    with np.errstate(all="ignore"):
        x = -np.log1p(rates * days / _ONE)
        last = np.full(len(x), np.inf)
        for _ in range(60):
            f = np.exp(x @ w.T)
            end = np.exp(x)
            miss = rates * (f @ sums.T) + end - 1
            last = np.abs(miss).max(1)
            live = np.isfinite(last) & (last > 1e-14)
            if not live.any():
                break
            slope = rates[live, :, None] * np.einsum("ip,bp,pj->bij", sums, f[live], w, optimize=True)
            slope[:, np.arange(n), np.arange(n)] += end[live]
            ok = np.abs(np.linalg.det(slope)) > 0
            step = np.full((len(ok), n), np.nan)
            step[ok] = np.linalg.solve(slope[ok], miss[live][ok][..., None])[..., 0]
            x[live] = x[live] - np.clip(step, -1.0, 1.0)
    return np.where((last < 1e-11)[:, None], x, np.nan)


def _solver(every: int):
    @F.pandas_udf(_SOLVED)
    def solved(days: pd.Series, swaps: pd.Series, rates: pd.Series) -> pd.DataFrame:
        out = [(None, None)] * len(days)
        grids: dict[tuple, list[int]] = {}
        for i, (d, s) in enumerate(zip(days, swaps, strict=True)):
            grids.setdefault((tuple(d), tuple(s)), []).append(i)
        for (d, s), rows in grids.items():
            t = np.array(d, float)
            x = solve(t, np.array(s, bool), np.array([rates.iloc[i] for i in rows], float), every)
            m = x @ bends(t).T
            for i, values, curved in zip(rows, x, m, strict=True):
                if np.isfinite(values).all():
                    out[i] = (values.tolist(), curved[1:].tolist())
        return pd.DataFrame(out, columns=["logdf", "bend"])

    return solved


def cubic_curves(quotes: DataFrame, curve: str = "curve_id", frequency_days: int = 182) -> DataFrame:
    """(curve, points): points of (days, logdf, bend), day 0 first, from quotes (curve, kind "deposit" or "swap", days, rate).

    All of a curve's quotes are solved for together, as a payment between two of them depends on the quotes on both sides. A swap pays
    every frequency_days for the days since the payment before, ACT/360, and on its last day; a deposit pays once. Simple rates.
    Quotes without a rate or with days below 1 are left out; of several on a day the lowest stays, of equal ones the deposit. A curve that
    can't be solved has no points (null). A curve has tens of quotes, and only they are gathered; curves on the same days
    share their matrices in a batch.
    """
    bad = quotes.where(~F.col("kind").isin("deposit", "swap") | F.col("kind").isNull()).select(F.col(curve), F.raise_error(F.concat(F.lit("no kind of quote: "), F.coalesce("kind", F.lit("null")))).cast("double").alias("rate"))
    clean = quotes.where((F.col("days") > 0) & F.col("rate").isNotNull() & ~F.isnan("rate") & F.col("kind").isin("deposit", "swap"))
    best = clean.groupBy(curve, F.col("days").cast("double").alias("days")).agg(F.min(F.struct(F.col("rate").cast("double").alias("rate"), (F.col("kind") == "swap").alias("swap"))).alias("q"))
    best = best.select(curve, "days", "q.rate", "q.swap").unionByName(bad.select(curve, F.col("rate").alias("days"), "rate", F.lit(False).alias("swap")))
    got = best.groupBy(curve).agg(F.array_sort(F.collect_list(F.struct("days", "swap", "rate"))).alias("q"))
    got = got.withColumn("s", _solver(frequency_days)(F.col("q.days"), F.col("q.swap"), F.col("q.rate")))
    point = lambda d, x, m: F.struct(d.alias("days"), x.alias("logdf"), m.alias("bend"))
    start = F.array(point(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    made = F.transform(F.arrays_zip(F.col("q.days").alias("d"), F.col("s.logdf").alias("x"), F.col("s.bend").alias("m")), lambda p: point(p["d"], p["x"], p["m"]))
    return got.select(curve, F.when(F.col("s.logdf").isNotNull(), F.concat(start, made)).alias("points"))


def cubic_factor_at(points: Column, days: Column) -> Column:
    """Discount factor on a curve of cubic_curves; beyond the last point its slope there is carried on, before day 0 it is 1."""
    d = F.greatest(days.cast("double"), F.lit(0.0))
    n = F.size(points)
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(points, lambda p: p["days"] <= d)), n - 1))
    a, b = F.element_at(points, i), F.element_at(points, i + 1)
    h = b["days"] - a["days"]
    u = (b["days"] - d) / h
    v = 1 - u
    inside = u * a["logdf"] + v * b["logdf"] + ((u * u * u - u) * a["bend"] + (v * v * v - v) * b["bend"]) * h * h / 6
    slope = (b["logdf"] - a["logdf"]) / h + h * (a["bend"] + 2 * b["bend"]) / 6
    return F.exp(F.when(d > b["days"], b["logdf"] + slope * (d - b["days"])).otherwise(inside))


def cubic_discounted(rows: DataFrame, made: DataFrame, days: str = "days", curve: str = "curve_id", name: str = "df") -> DataFrame:
    """Adds the discount factor of each row's days on its curve of cubic_curves; null without a curve or days."""
    own = made.select(F.col(curve), F.col("points").alias("curve points"))
    return rows.join(own, curve, "left").withColumn(name, F.when(F.col(days).isNotNull(), cubic_factor_at(F.col("curve points"), F.col(days)))).drop("curve points")


def par_rates(quotes: DataFrame, made: DataFrame, curve: str = "curve_id", frequency_days: int = 182) -> DataFrame:
    """quotes with par: the rate at which each is worth nothing on its curve of cubic_curves."""
    own = made.select(F.col(curve), F.col("points").alias("curve points"))
    d = F.col("days").cast("double")
    whole = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(d / frequency_days).cast("int"))), lambda k: k * float(frequency_days)), lambda x: x < d)
    paid = F.when(F.col("kind") == "swap", F.concat(whole, F.array(d))).otherwise(F.array(d))
    worth = F.aggregate("curve paid", F.struct(F.lit(0.0).alias("day"), F.lit(0.0).alias("sum")), lambda s, x: F.struct(x.alias("day"), (s["sum"] + (x - s["day"]) / _ONE * cubic_factor_at(F.col("curve points"), x)).alias("sum")), lambda s: s["sum"])
    out = quotes.join(own, curve, "left").withColumn("curve paid", F.when(d > 0, paid))
    return out.withColumn("par", (1 - cubic_factor_at(F.col("curve points"), d)) / worth).drop("curve points", "curve paid")
