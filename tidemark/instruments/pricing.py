"""Prices of bonds, swaps and options as column expressions over rows of instruments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import adjusted, normal_cdf, normal_density, year_fraction
from ..operators.fill import asof
from .curves import factor_at, on_curve


def schedule(start: Column, end: Column, months: Column, rule: str = "FOLLOWING") -> Column:
    """Period dates from start to end (forward, a short last period), business-day adjusted; at least start and end."""
    n = F.ceil(F.months_between(end, start) / months).cast("int")
    dates = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda k: F.least(F.add_months(start, (k * months).cast("int")), end))
    return F.array_distinct(F.transform(dates, lambda d: adjusted(d, rule)))


def periods(rows: DataFrame, rule: str = "FOLLOWING") -> DataFrame:
    """A row for each period: rows' columns, period_start, payment_date. rows has start_date, end_date, months."""
    dates = schedule(F.col("start_date"), F.col("end_date"), F.col("months"), rule)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_d") - 1), lambda i: F.struct(F.element_at("_d", i).alias("period_start"), F.element_at("_d", i + 1).alias("payment_date")))
    return rows.withColumn("_d", dates).withColumn("_p", F.explode(F.when(F.size("_d") > 1, pairs))).select(*rows.columns, "_p.*")


def bond_cashflows(bonds: DataFrame, basis: str = "ACT/360", rule: str = "FOLLOWING") -> DataFrame:
    """(ins_id, leg, payment_date, amount): coupons on face, and face at the end. bonds: ins_id, face, coupon, start_date, end_date, months."""
    p = periods(bonds, rule)
    coupons = p.select("ins_id", F.lit("coupon").alias("leg"), "payment_date", (F.col("face") * F.col("coupon") * year_fraction(F.col("period_start"), F.col("payment_date"), basis)).alias("amount"))
    redemption = bonds.select("ins_id", F.lit("redemption").alias("leg"), adjusted(F.col("end_date"), rule).alias("payment_date"), F.col("face").cast("double").alias("amount"))
    return coupons.where("amount <> 0").unionByName(redemption)


def floating_bond_cashflows(bonds: DataFrame, nodes: DataFrame, valuation: Column, rule: str = "FOLLOWING") -> DataFrame:
    """As bond_cashflows with coupons of the curve's forwards plus the bond's margin; needs margin and curve_id.

    A period that began before the valuation date takes the forward from that date.
    """
    p = on_curve(periods(bonds, rule), nodes)
    tau = year_fraction(F.col("period_start"), F.col("payment_date"))
    begin, end = F.greatest(F.datediff("period_start", valuation), F.lit(0)), F.datediff("payment_date", valuation)
    forward = (factor_at(F.col("points"), begin) / factor_at(F.col("points"), end) - 1) / ((end - begin) / 360.0)
    coupons = p.where(end > 0).select("ins_id", F.lit("coupon").alias("leg"), "payment_date", (F.col("face") * (forward + F.col("margin")) * tau).alias("amount"))
    redemption = bonds.select("ins_id", F.lit("redemption").alias("leg"), adjusted(F.col("end_date"), rule).alias("payment_date"), F.col("face").cast("double").alias("amount"))
    return coupons.unionByName(redemption)


def spreads(cashflows: DataFrame, instruments: DataFrame, nodes: DataFrame, prices: DataFrame, valuation: Column) -> DataFrame:
    """(ins_id, spread): the continuous spread over the curve at which the flows are worth the dirty value (ins_id, value).

    Flows are discounted on the curve first, so that the spread is the yield of what is left.
    """
    rows = on_curve(cashflows.join(instruments.select("ins_id", "curve_id"), "ins_id"), nodes)
    days = F.datediff("payment_date", valuation)
    flow = F.struct((days / 365.0).alias("t"), (F.col("amount") * factor_at(F.col("points"), days)).alias("a"))
    left = rows.where(days > 0).groupBy("ins_id").agg(F.array_sort(F.collect_list(flow)).alias("f"))
    return left.join(prices, "ins_id").select("ins_id", solve_yield("value", F.col("f.t"), F.col("f.a")).alias("spread"))


def present_value(cashflows: DataFrame, instruments: DataFrame, nodes: DataFrame, valuation: Column, spread: Column | float = 0.0) -> DataFrame:
    """(ins_id, npv): flows after the valuation date, discounted on the instrument's curve plus a continuous spread."""
    rows = on_curve(cashflows.join(instruments.select("ins_id", "curve_id"), "ins_id"), nodes)
    days = F.datediff("payment_date", valuation)
    s = F.lit(spread) if isinstance(spread, float) else spread
    value = F.when(days > 0, F.col("amount") * factor_at(F.col("points"), days) * F.exp(-s * days / 365.0)).otherwise(0.0)
    return rows.groupBy("ins_id").agg(F.sum(value).alias("npv"))


def bond_prices(bonds: DataFrame, nodes: DataFrame, valuation: Column, basis: str = "ACT/360") -> DataFrame:
    """(ins_id, npv, accrued, clean, dirty) per 100 of face. A bond with no period left is its redemption alone."""
    flows = bond_cashflows(bonds, basis)
    value = present_value(flows, bonds, nodes, valuation)
    running = periods(bonds).where((F.col("period_start") <= valuation) & (F.col("payment_date") > valuation))
    accrued = running.select("ins_id", (100 * F.col("coupon") * year_fraction(F.col("period_start"), valuation, basis)).alias("accrued"))
    out = bonds.select("ins_id", "face").join(value, "ins_id", "left").join(accrued, "ins_id", "left").fillna(0.0, ["accrued"])
    dirty = F.col("npv") / F.col("face") * 100
    return out.select("ins_id", "npv", "accrued", (dirty - F.col("accrued")).alias("clean"), dirty.alias("dirty"))


@F.pandas_udf(T.DoubleType())
def solve_yield(price: pd.Series, times: pd.Series, amounts: pd.Series) -> pd.Series:
    """Continuous yield at which the flows are worth the price, by Newton steps on all rows of a batch at once; null if it doesn't settle."""
    n = times.map(len).to_numpy()
    if len(n) == 0:
        return pd.Series([], dtype=float)
    inside = np.arange(n.max(initial=1))[None] < n[:, None]
    t, a = np.zeros(inside.shape), np.zeros(inside.shape)
    if n.sum():
        t[inside], a[inside] = np.concatenate(times.to_list()), np.concatenate(amounts.to_list())
    p, y, settled = price.to_numpy(dtype=float), np.full(len(n), 0.05), np.zeros(len(n), bool)
    for _ in range(100):
        with np.errstate(all="ignore"):
            d = a * np.exp(-y[:, None] * t)
            step = np.clip((d.sum(1) - p) / -(t * d).sum(1), -0.5, 0.5)
        step = np.where(settled | ~np.isfinite(step), 0.0, step)
        y = y - step
        settled |= (np.abs(step) < 1e-12) & (step != 0) | (np.abs((a * np.exp(-y[:, None] * t)).sum(1) - p) <= 1e-12 * np.maximum(1, np.abs(p)))
        if settled.all():
            break
    return pd.Series(np.where(settled, y, np.nan)).astype(object).where(settled, None).astype(float)


def yields(cashflows: DataFrame, prices: DataFrame, valuation: Column) -> DataFrame:
    """(ins_id, yield) from dirty values (ins_id, value)."""
    left = cashflows.where(F.col("payment_date") > valuation).groupBy("ins_id").agg(F.array_sort(F.collect_list(F.struct((F.datediff("payment_date", valuation) / 365.0).alias("t"), F.col("amount").alias("a")))).alias("f"))
    return left.join(prices, "ins_id").select("ins_id", solve_yield("value", F.col("f.t"), F.col("f.a")).alias("yield"))


def _fixed_leg(p: DataFrame) -> DataFrame:
    tau = year_fraction(F.col("period_start"), F.col("payment_date"))
    return p.select("ins_id", F.lit("fixed").alias("leg"), "payment_date", (-F.col("notional") * F.col("fixed_rate") * tau).alias("amount"))


def spot_start(swaps: DataFrame, trade: Column, days: int = 2) -> DataFrame:
    """Swaps without a start date begin ``days`` business days (weekdays) after the trade date."""
    spot = trade
    for _ in range(days):
        spot = adjusted(F.date_add(spot, 1))
    return swaps.withColumn("start_date", F.coalesce("start_date", spot))


def growth(spans: DataFrame, fixings: DataFrame) -> DataFrame:
    """Adds grown to (curve_id, period_start, period_end): what 1 becomes at the fixings (curve_id, fixing_date, rate), each for the days until the next.

    Running products of a curve's growth are taken once; a span is the ratio of two of them, with the fixings that its ends
    cut in part. Both ends are looked up as of their day, so spans and fixings never meet in a join. Days before the first fixing don't grow.
    """
    w = Window.partitionBy("curve_id").orderBy("day")
    f = fixings.select("curve_id", F.col("fixing_date").alias("day"), "rate").withColumns({"next": F.lead("day").over(w), "fixed": F.col("day")})
    f = f.withColumn("step", F.coalesce(1 + F.col("rate") * F.datediff("next", "day") / 360.0, F.lit(1.0)))
    before = F.coalesce(F.product("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    f = f.withColumn("before", before).select("curve_id", "day", F.struct("fixed", "next", "rate", "before", "step").alias("at"))
    ends = spans.select("curve_id", F.explode(F.array("period_start", F.date_add("period_end", -1))).alias("day")).distinct()
    found = asof(ends, f, ["at"], ("curve_id",), "day")
    side = lambda x, day: found.select("curve_id", F.col("day").alias(day), F.col("at").alias(x))
    out = spans.withColumn("_last", F.date_add("period_end", -1)).join(side("a", "period_start"), ["curve_id", "period_start"]).join(side("b", "_last"), ["curve_id", "_last"])
    part = lambda x, lo, hi: 1 + F.col(f"{x}.rate") * F.datediff(hi, lo) / 360.0
    whole = part("a", F.col("period_start"), F.col("a.next")) * F.col("b.before") / (F.col("a.before") * F.col("a.step")) * part("b", F.col("b.fixed"), F.col("period_end"))
    none = F.col("b.before") * part("b", F.col("b.fixed"), F.col("period_end"))
    same = part("b", F.greatest("b.fixed", "period_start"), F.col("period_end"))
    made = F.when(F.col("b").isNull(), 1.0).when(F.col("a").isNull(), none).when(F.col("a.fixed") == F.col("b.fixed"), same).otherwise(whole)
    return out.select("curve_id", "period_start", "period_end", made.alias("grown"))


def swap_cashflows(swaps: DataFrame, nodes: DataFrame, valuation: Column, rule: str = "MODIFIED", fixings: DataFrame | None = None) -> DataFrame:
    """(ins_id, leg, payment_date, amount) of pay-fixed swaps: ins_id, notional, fixed_rate, start_date, end_date, months, curve_id.

    A floating period's rate is the curve's forward over the period. One that began on or before the valuation date takes
    the last fixing (curve_id, fixing_date, rate) on or before its start; without one the forward from the valuation date.
    """
    p = periods(swaps, rule)
    fixed = _fixed_leg(p)
    known = F.lit(None).cast("double")
    if fixings is not None:
        begun = p.where(F.col("period_start") <= valuation).select("curve_id", "period_start").distinct()
        last = asof(begun, fixings.select("curve_id", F.col("fixing_date").alias("period_start"), F.col("rate").alias("fixing")), ["fixing"], ("curve_id",), "period_start")
        p, known = p.join(last, ["curve_id", "period_start"], "left"), F.col("fixing")
    p = on_curve(p, nodes)
    tau = year_fraction(F.col("period_start"), F.col("payment_date"))
    begin = F.greatest(F.datediff("period_start", valuation), F.lit(0))
    end = F.datediff("payment_date", valuation)
    forward = (factor_at(F.col("points"), begin) / factor_at(F.col("points"), end) - 1) / ((end - begin) / 360.0)
    rate = F.coalesce(known, F.when(end > 0, forward).otherwise(0.0))
    floating = p.select("ins_id", F.lit("floating").alias("leg"), "payment_date", (F.col("notional") * rate * tau).alias("amount"))
    return fixed.unionByName(floating)


def overnight_cashflows(swaps: DataFrame, nodes: DataFrame, valuation: Column, fixings: DataFrame, rule: str = "MODIFIED") -> DataFrame:
    """As swap_cashflows with a floating leg that compounds overnight rates over each period.

    Before the valuation date the fixings (curve_id, fixing_date, rate) compound, each for the days until the next one, the
    period's end or the valuation date; from then on the curve's factors, which compound to their ratio.
    """
    p = periods(swaps, rule)
    begun = p.where(F.col("period_start") < valuation).select("curve_id", "period_start", F.least("payment_date", valuation).alias("period_end")).distinct()
    grown = growth(begun, fixings)
    p2 = on_curve(p.withColumn("period_end", F.least("payment_date", valuation)).join(grown, ["curve_id", "period_start", "period_end"], "left"), nodes)
    begin, end = F.greatest(F.datediff("period_start", valuation), F.lit(0)), F.datediff("payment_date", valuation)
    ahead = F.when(end > 0, factor_at(F.col("points"), begin) / factor_at(F.col("points"), end)).otherwise(1.0)
    floating = p2.select("ins_id", F.lit("floating").alias("leg"), "payment_date", (F.col("notional") * (F.coalesce("grown", F.lit(1.0)) * ahead - 1)).alias("amount"))
    return _fixed_leg(p).unionByName(floating)


def black_scholes(spot: Column, strike: Column, years: Column, vol: Column, rate: Column, carry: Column, is_call: Column) -> dict[str, Column]:
    """Price and greeks of a European option with continuous rates; carry is the dividend or the foreign rate.

    vega and rho are per point of 1 %, theta per day.
    """
    root = F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate - carry + vol * vol / 2) * years) / (vol * root)
    d2 = d1 - vol * root
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    own, other = F.exp(-carry * years), F.exp(-rate * years)
    n1, n2 = normal_cdf(sign * d1), normal_cdf(sign * d2)
    price = sign * (spot * own * n1 - strike * other * n2)
    decay = -spot * own * normal_density(d1) * vol / (2 * root) - sign * rate * strike * other * n2 + sign * carry * spot * own * n1
    return {
        "price": price, "delta": sign * own * n1, "gamma": own * normal_density(d1) / (spot * vol * root), "vega": spot * own * normal_density(d1) * root / 100,
        "theta": decay / 365, "rho": sign * strike * years * other * n2 / 100,
    }


def option_prices(options: DataFrame) -> DataFrame:
    """Adds price and greeks; rows: spot, strike, years, volatility, rate, carry, is_call, notional."""
    c = F.col
    made = black_scholes(c("spot"), c("strike"), c("years"), c("volatility"), c("rate"), c("carry"), c("is_call"))
    return options.withColumns({k: v * (c("notional") if "notional" in options.columns else 1) for k, v in made.items()})


def knock_out(spot: Column, strike: Column, barrier: Column, years: Column, vol: Column, rate: Column, carry: Column, is_call: Column) -> Column:
    """Analytic price of a knock-out option, barrier watched all the time, no rebate; down if the barrier is below the spot.

    0 once the spot has reached the barrier.
    """
    s2t = vol * F.sqrt(years)
    mu = (rate - carry - vol * vol / 2) / (vol * vol)
    phi = F.when(is_call, 1.0).otherwise(-1.0)
    eta = F.when(barrier < spot, 1.0).otherwise(-1.0)
    h = barrier / spot
    own, other = F.exp(-carry * years), F.exp(-rate * years)
    x1 = F.log(spot / strike) / s2t + (1 + mu) * s2t
    x2 = F.log(spot / barrier) / s2t + (1 + mu) * s2t
    y1 = F.log(barrier * barrier / (spot * strike)) / s2t + (1 + mu) * s2t
    y2 = F.log(h) / s2t + (1 + mu) * s2t
    plain = lambda x: phi * (spot * own * normal_cdf(phi * x) - strike * other * normal_cdf(phi * (x - s2t)))
    mirrored = lambda y: phi * (spot * own * F.pow(h, 2 * (mu + 1)) * normal_cdf(eta * y) - strike * other * F.pow(h, 2 * mu) * normal_cdf(eta * (y - s2t)))

    def chosen(q: Column) -> Column:
        a, b, c, d = (F.get(q, i) for i in range(4))
        down = F.when(is_call, F.when(strike >= barrier, a - c).otherwise(b - d)).otherwise(F.when(strike >= barrier, a - b + c - d).otherwise(0.0))
        up = F.when(is_call, F.when(strike >= barrier, F.lit(0.0)).otherwise(a - b + c - d)).otherwise(F.when(strike >= barrier, b - d).otherwise(a - c))
        return F.when(barrier < spot, down).otherwise(up)

    # the array names the four terms, so that each is computed once
    out = F.get(F.transform(F.array(F.array(plain(x1), plain(x2), mirrored(y1), mirrored(y2))), chosen), 0)
    return F.when(barrier == spot, 0.0).otherwise(F.greatest(out, F.lit(0.0)))


def barrier_distance(spot: Column, barrier: Column) -> Column:
    return (barrier - spot) / spot
