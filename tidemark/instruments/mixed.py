"""Instruments of several types in one table, each type priced by its own kernel, under one protocol.

A row holds ins_id (once), kind, and the terms that its kind needs; terms of other kinds are null. Every kernel is a plan over the rows of its kind, and
their results are a union: the table is read once a kind, with the kind pushed down, and prices of options need no shuffle
because flows of bonds and swaps do. Rollups over units are those of ``position``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pricing


@dataclass(frozen=True)
class Market:
    """What instruments are priced on: a valuation date, nodes of zero curves, and past fixings if there are any."""

    valuation: Column
    nodes: DataFrame
    fixings: DataFrame | None = None


@dataclass(frozen=True)
class Kernel:
    """prices gives (ins_id, price) for each row; flows (ins_id, leg, payment_date, amount) and greeks (ins_id, greeks) are there if the kind has them."""

    prices: Callable[[DataFrame, Market], DataFrame]
    flows: Callable[[DataFrame, Market], DataFrame] | None = None
    greeks: Callable[[DataFrame, Market], DataFrame] | None = None


def by_flows(flows: Callable[[DataFrame, Market], DataFrame]) -> Kernel:
    """A kind that is worth its flows, discounted on its curve; without a flow left it is worth 0."""

    def prices(rows: DataFrame, market: Market) -> DataFrame:
        value = pricing.present_value(flows(rows, market), rows, market.nodes, market.valuation)
        return rows.select("ins_id").join(value, "ins_id", "left").select("ins_id", F.coalesce("npv", F.lit(0.0)).alias("price"))

    return Kernel(prices, flows)


_GREEKS = ("delta", "gamma", "vega", "theta", "rho")


def by_terms(price: Callable[[DataFrame], Column], sensitivities: Callable[[DataFrame], Column]) -> Kernel:
    """A kind whose price and struct of greeks are expressions of a row, times its notional (1 if null)."""

    def size(rows: DataFrame) -> Column:
        return F.coalesce(F.col("notional"), F.lit(1.0)) if "notional" in rows.columns else F.lit(1.0)

    def prices(rows: DataFrame, market: Market) -> DataFrame:
        return rows.select("ins_id", (price(rows) * size(rows)).alias("price"))

    def greeks(rows: DataFrame, market: Market) -> DataFrame:
        made = rows.select("ins_id", size(rows).alias("size"), sensitivities(rows).alias("made"))
        return made.select("ins_id", F.create_map(*(x for k in _GREEKS for x in (F.lit(k), F.col(f"made.{k}") * F.col("size")))).alias("greeks"))

    return Kernel(prices, None, greeks)


def _terms(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _european(rows: DataFrame) -> dict[str, Column]:
    return pricing.black_scholes(*_terms("spot", "strike", "years", "volatility", "rate", "carry", "is_call"))


def knock_out_greeks(spot: Column, strike: Column, barrier: Column, years: Column, vol: Column, rate: Column, carry: Column, is_call: Column) -> Column:
    """Struct of a knock-out option's greeks by central differences, in units as for European ones; all 0 on the barrier.

    theta is what the price gains in a day (it tends to lose). A bump of the spot doesn't cross the barrier.
    """
    given = {"spot": spot, "strike": strike, "barrier": barrier, "years": years, "vol": vol, "rate": rate, "carry": carry, "is_call": is_call}
    h = F.least(spot * 1e-4, F.abs(spot - barrier) / 4)
    day = F.least(F.lit(1 / 365.0), years / 2)
    bumps = [{}, {"spot": spot + h}, {"spot": spot - h}, {"vol": vol + 1e-4}, {"vol": vol - 1e-4}, {"rate": rate + 1e-5}, {"rate": rate - 1e-5}, {"years": years - day}]
    # one price expression serves all bumps, and the array around the prices names them, so that they are computed once
    terms = F.array(*(F.struct(*((given | b)[k].alias(k) for k in given)) for b in bumps))
    priced = F.transform(terms, lambda x: pricing.knock_out(*(x[k] for k in given)))

    def differences(p: Column) -> Column:
        at = [F.get(p, i) for i in range(len(bumps))]
        out = {"delta": (at[1] - at[2]) / (2 * h), "gamma": (at[1] - 2 * at[0] + at[2]) / (h * h), "vega": (at[3] - at[4]) / 2e-4 / 100, "theta": (at[7] - at[0]) / (day * 365), "rho": (at[5] - at[6]) / 2e-5 / 100}
        return F.struct(*(F.when(spot == barrier, 0.0).otherwise(v).alias(k) for k, v in out.items()))

    return F.get(F.transform(F.array(priced), differences), 0)


_KNOCK_OUT = ("spot", "strike", "barrier", "years", "volatility", "rate", "carry", "is_call")


def _passed(rows: DataFrame) -> Column:
    """Whether the spot has passed the barrier in the option's own direction; where barrier_type is null the spot tells the direction."""
    if "barrier_type" not in rows.columns:
        return F.lit(False)
    up, down = F.col("barrier_type") == "up_and_out", F.col("barrier_type") == "down_and_out"
    return F.coalesce((up & (F.col("spot") >= F.col("barrier"))) | (down & (F.col("spot") <= F.col("barrier"))), F.lit(False))


def _knock_out_price(rows: DataFrame) -> Column:
    return F.when(_passed(rows), 0.0).otherwise(pricing.knock_out(*_terms(*_KNOCK_OUT)))


def _knock_out_greeks(rows: DataFrame) -> Column:
    return F.when(_passed(rows), F.struct(*(F.lit(0.0).alias(k) for k in _GREEKS))).otherwise(knock_out_greeks(*_terms(*_KNOCK_OUT)))


def _european_greeks(rows: DataFrame) -> Column:
    made = _european(rows)
    return F.struct(*(made[k].alias(k) for k in _GREEKS))


def _swaps(rows: DataFrame, market: Market) -> DataFrame:
    return pricing.swap_cashflows(rows, market.nodes, market.valuation, fixings=market.fixings)


def _overnight(rows: DataFrame, market: Market) -> DataFrame:
    if market.fixings is None:
        raise ValueError("overnight swaps need fixings")
    return pricing.overnight_cashflows(rows, market.nodes, market.valuation, market.fixings)


#: Kinds that are known; a mapping with more of them can be passed to the functions below.
KERNELS: dict[str, Kernel] = {
    "fixed_bond": by_flows(lambda rows, market: pricing.bond_cashflows(rows)),
    "floating_bond": by_flows(lambda rows, market: pricing.floating_bond_cashflows(rows, market.nodes, market.valuation)),
    "swap": by_flows(_swaps),
    "overnight_swap": by_flows(_overnight),
    "european_option": by_terms(lambda rows: _european(rows)["price"], _european_greeks),
    "fx_option": by_terms(lambda rows: _european(rows)["price"], _european_greeks),
    "knock_out": by_terms(_knock_out_price, _knock_out_greeks),
}


def _united(instruments: DataFrame, market: Market, kernels: Mapping[str, Kernel], part: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """The part of every kernel that has it, with the kind; a row of a kind without a kernel is an error when it is met."""
    chosen = [k for k in kernels if kinds is None or k in kinds]
    has = [k for k in chosen if getattr(kernels[k], part) is not None]
    if not has:
        raise ValueError(f"none of {', '.join(chosen)} has {part}")
    parts = [getattr(kernels[k], part)(instruments.where(F.col("kind") == k), market).withColumn("kind", F.lit(k)) for k in has]
    unknown = F.col("kind").isNull() | ~F.col("kind").isin(chosen)
    fields = parts[0].schema
    stop = F.raise_error(F.concat(F.lit("no kernel for "), F.coalesce("kind", F.lit("null"))))
    raised = instruments.where(unknown).select(*(stop.cast("string").cast(f.dataType).alias(f.name) if f.name == "kind" else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    return reduce(DataFrame.unionByName, [*parts, raised])


def prices(instruments: DataFrame, market: Market, kernels: Mapping[str, Kernel] = KERNELS, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(ins_id, price, kind) of every instrument. ``kinds``: those that can occur, so that no other kernel is planned. A price with a null term is null."""
    return _united(instruments, market, kernels, "prices", kinds)


def cashflows(instruments: DataFrame, market: Market, kernels: Mapping[str, Kernel] = KERNELS, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(ins_id, leg, payment_date, amount, kind) of every instrument that has flows; others have no rows."""
    return _united(instruments, market, kernels, "flows", kinds)


def greeks(instruments: DataFrame, market: Market, kernels: Mapping[str, Kernel] = KERNELS, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(ins_id, greeks, kind) of every instrument that has greeks; others have no rows."""
    return _united(instruments, market, kernels, "greeks", kinds)
