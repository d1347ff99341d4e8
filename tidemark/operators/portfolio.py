"""Rebalancing, portfolio returns net of fees, values, accounts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME, by_key
from .fill import asof, bfill, ffill
from .merge import combine_first
from .passes import double, ordered_pass
from .reshape import to_map
from .rolling import nav, simple_return

REBALANCERS: dict[str, object] = {}
FIELDS = ("weights", "price", "volume")


def rebalancer(name: str):
    def put(f):
        REBALANCERS[name] = f
        return f

    return put


@rebalancer("immediate")
def immediate(frame: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """weights, price, volume by key -> the same as _before and _current: what was current at the key's row before.

    frame is dense over its times. seed is the last stored row of each key: it comes before all and isn't returned.
    """
    rows = frame.withColumn("_seed", F.lit(False))
    if seed is not None:
        rows = seed.select(*frame.columns).withColumn("_seed", F.lit(True)).unionByName(rows)
    w = by_key()
    made = rows.select(TIME, KEY, "_seed", *(c for f in FIELDS for c in (F.coalesce(F.lag(f).over(w), F.lit(0.0)).alias(f"{f}_before") if f == "weights" else F.lag(f).over(w).alias(f"{f}_before"), F.col(f).alias(f"{f}_current"))))
    return made.where(~F.col("_seed")).drop("_seed")


@rebalancer("time_weighted")
def time_weighted(frame: DataFrame, targets: DataFrame, window: str) -> DataFrame:
    """Weights move in a straight line from what they were to each target over ``window`` after it is set.

    frame gives the times and keys, targets the weights set; the line starts at the target set before.
    """
    w = by_key()
    t = targets.select(TIME, KEY, F.col("weights").alias("_to"), F.coalesce(F.lag("weights").over(w), F.lit(0.0)).alias("_from"))
    at = asof(frame.select(TIME, KEY), t, ["_to", "_from"], source_time="_set")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    length = F.lit(float(pd.Timedelta(window).total_seconds()))
    done = F.least(F.lit(1.0), (seconds(F.col(TIME)) - seconds(F.col("_set"))) / length)
    return at.select(TIME, KEY, (F.col("_from") + (F.col("_to") - F.col("_from")) * done).alias("weights"))


@rebalancer("volume_participation")
def volume_participation(frame: DataFrame, notional: float, share: float, portfolio: str = "portfolio") -> DataFrame:
    """Weights approach their target no faster than ``share`` of a bar's dollar volume allows.

    frame has weights (the target), price, volume by portfolio, key and time; missing ones count as 0. Between two changes of a target
    the way to it is the smaller of the gap and the room so far, a running sum; only from one target to the next does a step
    depend on the one before. Series stream through tasks in batches: of a series a task keeps the weight held and the room used since the target was set.
    """

    def make():
        held, target, used, begun = 0.0, np.nan, 0.0, 0.0

        def step(x, begins):
            nonlocal held, target, used, begun
            want, room = np.nan_to_num(x[0]), np.nan_to_num(x[1])
            cut = np.flatnonzero(begins | (want != np.append(target, want[:-1])))
            out = np.empty(len(want))
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(want)), strict=True):
                if lo in cut[:1] or lo > 0:  # a new target, or a new series
                    begun, used = 0.0 if begins[lo] else held, 0.0
                if hi > lo:
                    sums = used + np.cumsum(room[lo:hi])
                    gap = want[lo] - begun
                    out[lo:hi] = begun + np.sign(gap) * np.minimum(np.abs(gap), sums)
                    held, used = float(out[hi - 1]), float(sums[-1])
            target = want[-1]
            return [out]

        return step

    room = share * F.col("price") * F.col("volume") / notional
    made = ordered_pass(frame.select(TIME, KEY, portfolio, "weights", "price", "volume"), [F.col("weights"), room], [double("_held")], make, (portfolio, KEY))
    return made.select(TIME, KEY, portfolio, F.col("_held").alias("weights"))


def portfolio_returns(rebalanced: DataFrame, prices: DataFrame | None, fee: float, signal_prices: DataFrame | None = None, price: str = "close", keys: Sequence[str] = ()) -> DataFrame:
    """(time_index, return): sum of weights before times returns, less turnover times fee.

    Prices are those of the signal where it has any; they are filled forward and taken at the rebalance times. Times at
    which any identifier of the rebalance has no price yet are left out. keys names further portfolio keys. Without prices
    those of the rebalance's own rows count (price_current), filled forward: nothing is joined.
    """
    w = Window.partitionBy(*keys, KEY).orderBy(TIME)
    if prices is None:
        known = F.last("price_current", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = rebalanced.select(TIME, KEY, *keys, "weights_before", "weights_current", known.alias(price))
        return _by_time(at.withColumn("_r", simple_return(F.col(price), w)), price, fee, keys).where("_missing = 0").select(*keys, TIME, "return")
    p = prices.select(TIME, KEY, price)
    if signal_prices is not None:
        p = combine_first(signal_prices.select(TIME, KEY, price), p)
    first = p.where(F.col(price).isNotNull()).agg(F.min(TIME).alias("_first"))
    cells = rebalanced.select(TIME, KEY, *keys, "weights_before", "weights_current")
    at = asof(cells, p, [price], (KEY,))
    by_time = _by_time(at.withColumn("_r", simple_return(F.col(price), w)), price, fee, keys)
    out = by_time.where("_missing = 0").crossJoin(F.broadcast(first)).where(F.col(TIME) >= F.col("_first"))
    return out.select(*keys, TIME, "return")


def _by_time(at: DataFrame, price: str, fee: float, keys: Sequence[str]) -> DataFrame:
    """return of each time, and how many identifiers have no price."""
    gain, turnover = F.sum(F.col("weights_before") * F.col("_r")), F.sum(F.abs(F.col("weights_current") - F.col("weights_before")))
    return at.groupBy(*keys, TIME).agg((gain - turnover * F.lit(fee)).alias("return"), F.sum(F.col(price).isNull().cast("int")).alias("_missing"))


def portfolio_values(returns: DataFrame, start: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Adds close: the running product from the last stored close. One series for each portfolio key."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(TIME)
    return returns.withColumn("close", nav(F.col("return"), start, w))


def serialized(portfolio: DataFrame, rebalanced: DataFrame) -> DataFrame:
    """Adds six JSON maps (weights, price, volume; current and before) and last_rebalance_date, filled forward; rows before the first are left out."""
    names = {"weights_current": "rebalance_weights", "price_current": "rebalance_price", "volume_current": "volume", "weights_before": "weights_at_last_rebalance", "price_before": "price_at_last_rebalance", "volume_before": "volume_at_last_rebalance"}
    maps = [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(KEY).alias("k"), F.col(c).alias("v"))))))).alias(n) for c, n in names.items()]
    wide = rebalanced.where(F.col(TIME).isNotNull()).groupBy(TIME).agg(*maps)
    # one series of times is filled, without the maps: each row meets those of the rebalance that it follows
    times = lambda df, side: df.select(F.col(TIME).alias("_at"), F.lit(side).alias("_side")).where("_at IS NOT NULL").distinct()
    w = Window.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = times(rebalanced, 0).unionByName(times(portfolio, 1))
    last = both.withColumn("_set", F.last(F.when(F.col("_side") == 0, F.col("_at")), ignorenulls=True).over(w)).where("_side = 1 AND _set IS NOT NULL")
    out = portfolio.join(last.select(F.col("_at").alias(TIME), "_set"), TIME).join(wide.withColumnRenamed(TIME, "_set"), "_set")
    return out.select(*portfolio.columns, *names.values(), F.date_format("_set", "yyyy-MM-dd HH:mm:ss").alias("last_rebalance_date"))


def last_weights(portfolio: DataFrame) -> DataFrame:
    """(unique_identifier, weights, price, volume) of the last stored row.

    Its time is found from the times alone, so that of the maps only those of that time are made and moved.
    """
    last = portfolio.where(F.col(TIME) == portfolio.agg(F.max(TIME)).scalar()).limit(1)
    maps = {"weights": "rebalance_weights", "price": "rebalance_price", "volume": "volume"}
    of = lambda v: lambda e: F.struct(e["key"].alias("k"), F.lit(v).alias("of"), e["value"].alias("v"))
    entries = [F.transform(F.map_entries(F.from_json(c, "map<string,double>")), of(v)) for v, c in maps.items()]
    rows = last.select(TIME, F.explode(F.concat(*(F.coalesce(e, F.array()) for e in entries))).alias("_e")).select(TIME, F.col("_e.k").alias(KEY), "_e.of", "_e.v")
    return rows.groupBy(TIME, KEY).agg(*(F.max(F.when(F.col("of") == v, F.col("v"))).alias(v) for v in maps))


def override_close(portfolio: DataFrame, prices: DataFrame, entity: str, price: str = "close") -> DataFrame:
    """The close of an asset on the portfolio's times (filled both ways); the portfolio's own stays as calculated_close."""
    p = portfolio.withColumnRenamed("close", "calculated_close").withColumn("_k", F.lit("all"))
    asset = prices.where(F.col(KEY) == entity).select(TIME, F.col(price).alias("close"), F.lit("all").alias("_k"))
    out = bfill(asof(p, asset, ["close"], ("_k",)), ["close"], ("_k",))
    w = Window.partitionBy("_k").orderBy(TIME)
    return out.withColumn("return", simple_return(F.col("close"), w)).drop("_k")


def account_rebalance(holdings: DataFrame, expected: DataFrame, nav_value: float, tolerance: float, signed: bool = False) -> DataFrame:
    """Trades that bring holdings (asset_id, quantity, price, order_time) to expected (asset_id, quantity).

    Quantities of an asset are summed and its last price taken. difference = expected - held; an asset is traded if
    its share of the account's value reaches the tolerance, by size, or with signed=True by sign as well.
    """
    held = holdings.groupBy("asset_id").agg(F.sum("quantity").alias("holding"), F.max_by("price", "order_time").alias("price"))
    want = expected.groupBy("asset_id").agg(F.sum("quantity").alias("expected"))
    both = held.join(want, "asset_id", "full_outer").fillna(0.0, ["holding", "expected"])
    both = both.withColumn("difference", F.col("expected") - F.col("holding")).withColumn("relative", F.col("difference") * F.col("price") / F.lit(float(nav_value)))
    size = F.col("relative") if signed else F.abs("relative")
    return both.withColumn("trade", F.when(size >= tolerance, F.col("difference")).otherwise(0.0))


def common_report(series: DataFrame, base: float = 100.0, value: str = "close") -> DataFrame:
    """Series of several portfolios on the union of their times, filled forward, rebased to ``base`` at the first time."""
    from .fill import dense
    from .rolling import rebased

    full = ffill(dense(series.select(TIME, KEY, value), series, series), [value])
    return full.withColumn("rebased", rebased(F.col(value), base))


def weights_to_map(weights: DataFrame, value: str = "signal_weight") -> DataFrame:
    return to_map(weights, value)
