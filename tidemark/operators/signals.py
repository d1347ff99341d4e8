"""Signals: weights of identifiers over time, in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME
from .passes import Cells, Fill, Lag, Windows, double, exponential, means, medians, ordered_pass
from .rolling import average_rank, padded_return

REGISTRY: dict[str, type | object] = {}


def register(name: str):
    """Registers a signal, a function or a class, under a name."""

    def put(f):
        if name in REGISTRY:
            raise ValueError(f"taken: {name}")
        REGISTRY[name] = f
        return f

    return put


@register("fixed")
def fixed_weights(spark: SparkSession, weights: Mapping[str, float], at: datetime = datetime(1985, 1, 1)) -> DataFrame:
    """Constant weights, set once."""
    return spark.createDataFrame([(at, k, float(v)) for k, v in weights.items()], f"{TIME} timestamp, {KEY} string, signal_weight double")


@register("alternating")
def alternating(grid: DataFrame, entities: Mapping[str, float]) -> DataFrame:
    """Weights that change sign at every step of the grid, for tests of a pipeline. The grid is a calendar, one row a step."""
    step = F.row_number().over(Window.orderBy(TIME))
    pairs = F.create_map(*(F.lit(x) for kv in entities.items() for x in kv))
    return grid.withColumn("_sign", F.when(step % 2 == 1, 1.0).otherwise(-1.0)).select(TIME, F.explode(pairs).alias(KEY, "_w"), "_sign").select(TIME, KEY, (F.col("_w") * F.col("_sign")).alias("signal_weight"))


def _mean_panel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(TIME, KEY).agg(*(F.avg(c).alias(c) for c in columns))


@register("market_cap")
def market_cap_weights(
    history: DataFrame, top: int, windows: Sequence[int] = (60, 360), min_atvr: float = 0.1, min_frequency: float = 0.9, periods: int = 252,
    target_volatility: float | None = None, volatility_span: float = 20.0, allow_lookahead: bool = True, densify: bool = True, keep: bool = False,
) -> DataFrame:
    """(time_index, unique_identifier, signal_weight): capitalisation shares of the liquid top names.

    history has market_cap, price and volume. Repeated keys are averaged; gaps are filled forward and, with
    allow_lookahead, backward. A name is liquid if in every window the median dollar volume, annualised, over its
    capitalisation reaches min_atvr, and in the longest window the share of days with volume reaches min_frequency.
    Ties in rank share their mean rank. A target volatility scales all weights of a time by min(1, target / volatility
    of the portfolio). All functions by name come from one pass over its rows in order, all by time share another shuffle.
    keep: whether price and volume, as they were before they were filled, come out beside the weights.
    """
    fields = ("market_cap", "price", "volume")
    panel = _mean_panel(history, fields)
    # what stands before a name's first value, one row a name
    names = panel.groupBy(KEY).agg(*((F.min_by(c, F.when(F.col(c).isNotNull(), F.col(TIME))) if allow_lookahead else F.lit(None).cast("double")).alias(f"_first_{c}") for c in fields))
    # rows of the panel are no cells of the grid; each stands before its cell, to which its values go
    rows = panel.select(TIME, KEY, *fields, F.lit(0).alias("_cell"))
    cells = panel.select(TIME).distinct().crossJoin(names) if densify else panel.select(TIME, KEY).join(names, KEY)
    both = rows.unionByName(cells.withColumn("_cell", F.lit(1)), allowMissingColumns=True)
    atvr = [f"_atvr{n}" for n in windows]

    def make():
        fills, before, known, log, traded, grid = [Fill() for _ in fields], [Lag() for _ in range(3)], [Fill() for _ in fields], Lag(), Windows(max(windows)), Cells()
        medians_of = [Windows(n) for n in windows]

        def step(x, begins):
            cell = x[6] == 1
            held = [f.take(v, begins) for f, v in zip(fills, x[:3], strict=True)]
            from_row = before[2].take(x[6], begins) == 0
            raw = [np.where(from_row, lag.take(v, begins), np.nan)[cell] for lag, v in zip(before, x[1:3], strict=False)]
            first = grid.take(cell, begins)
            if not cell.any():
                return [cell, *[np.zeros(0)] * (5 + len(windows))]
            cap, price, volume = (k.take(v[cell], first, v0[cell]) for k, v, v0 in zip(known, held, x[3:6], strict=True))
            with np.errstate(invalid="ignore", divide="ignore"):
                turnover = [np.where(cap > 0, medians(price * volume, first, w) * periods / cap, np.nan) for w in medians_of]
                logs = np.where(price > 0, np.log(price), np.nan)
            share = means((volume > 0).astype(float), first, traded)
            return [cell, cap, *raw, *turnover, share, logs - log.take(logs, first)]

        return step

    inputs = [F.col(c) for c in (*fields, *(f"_first_{c}" for c in fields), "_cell")]
    made = ordered_pass(both.select(TIME, KEY, *fields, *(f"_first_{c}" for c in fields), "_cell"), inputs, [double(c) for c in ("_filled", "_raw_price", "_raw_volume", *atvr, "_traded", "_move")], make, order=["_cell"], drops=True)
    liquid = F.lit(True)
    for c in atvr:
        liquid = liquid & (F.col(c) >= min_atvr)
    liquid = F.coalesce(liquid & (F.col("_traded") >= min_frequency), F.lit(False))
    # the shuffle by time carries what is needed there and no figures that liquidity comes from
    carried = (["_raw_price", "_raw_volume"] if keep else []) + (["_move"] if target_volatility is not None else [])
    panel = made.select(TIME, KEY, F.col("_filled").alias("market_cap"), liquid.alias("_liquid"), *carried).repartition(TIME)
    # the cap of what is not liquid still has a rank, as ranks are taken before the filter
    panel = panel.withColumn("_rank", average_rank(F.col("market_cap"), TIME))
    kept = F.when(F.col("_liquid") & (F.coalesce(F.col("_rank"), F.lit(0.0)) <= top), F.coalesce("market_cap", F.lit(0.0))).otherwise(0.0)
    panel = panel.withColumn("_cap", kept)
    total = F.sum("_cap").over(Window.partitionBy(TIME))
    panel = panel.withColumn("signal_weight", F.coalesce(F.when(total != 0, F.col("_cap") / total), F.lit(0.0)))
    raw = [F.col(f"_raw_{c}").alias(c) for c in ("price", "volume")] if keep else []
    if target_volatility is None:
        return panel.select(TIME, KEY, "signal_weight", *raw)
    moves = panel.groupBy(TIME).agg(F.coalesce(F.sum(F.col("_move") * F.col("signal_weight")), F.lit(0.0)).alias("_r"))
    # one row a time: a calendar
    vol = exponential(moves.withColumn("_one", F.lit(0)), {"_sd": ("std", F.col("_r"), volatility_span)}, ("_one",))
    scale = vol.withColumn("_vol", F.col("_sd") * F.sqrt(F.lit(float(periods)))).select(TIME, F.coalesce(F.least(F.lit(1.0), F.when(F.col("_vol") > 0, target_volatility / F.col("_vol"))), F.lit(1.0)).alias("_scale"))
    return panel.join(scale, TIME).select(TIME, KEY, (F.col("signal_weight") * F.col("_scale")).alias("signal_weight"), *raw)


@register("replication")
def replication_weights(prices: DataFrame, target: str, members: Sequence[str], n: int, alpha: float = 0.0, l1_ratio: float = 1.0, price: str = "close") -> DataFrame:
    """Rolling non-negative weights of the members that track the target's returns; times without the target are left out."""
    from .models import rolling_regression
    from .reshape import to_wide

    names = [target, *members]
    wide = to_wide(prices.where(F.col(KEY).isin(names)), price, names).where(F.col(f"`{target}`").isNotNull())
    w = Window.partitionBy(F.lit(0)).orderBy(TIME)
    wide = wide.select(TIME, *(padded_return(F.col(f"`{c}`"), w).alias(f"r{i}") for i, c in enumerate(names)), F.lit("all").alias("_k"))
    fitted = rolling_regression(wide, "r0", [f"r{i + 1}" for i in range(len(members))], n, alpha, l1_ratio, key="_k")
    who = F.create_map(*(F.lit(x) for i, m in enumerate(members) for x in (f"r{i + 1}", m)))
    return fitted.where(F.col("weights").isNotNull()).select(TIME, F.explode("weights").alias("_r", "signal_weight")).select(TIME, who[F.col("_r")].alias(KEY), "signal_weight")


@register("intraday_trend")
def intraday_trend_weights(bars: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Positions built up over the day in the direction of the previous day's open-to-close return, flat at the day's end.

    A bar whose return has that direction adds 1 / bars of the day.
    """
    day = F.to_date(time)
    b = bars.withColumn("_day", day)
    days = b.groupBy(key, "_day").agg((F.max_by("close", time) / F.min_by("open", time) - 1).alias("_ret"), F.count("*").alias("_n"))
    days = days.withColumn("_dir", F.signum(F.lag("_ret").over(Window.partitionBy(key).orderBy("_day")))).select(F.col(key).alias("_k"), F.col("_day").alias("_d"), "_dir", "_n")
    b = b.join(days, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")))
    inside = Window.partitionBy(key, "_day").orderBy(time)
    hit = F.when(F.signum(F.col("close") - F.col("open")) == F.col("_dir"), 1).otherwise(0)
    b = b.withColumn("_hit", hit).withColumn("_sum", F.sum("_hit").over(inside)).withColumn("_last", F.lead(time).over(inside).isNull())
    weight = F.when(F.col("_last"), 0.0).otherwise(F.coalesce(F.col("_dir") * F.col("_sum") / F.col("_n"), F.lit(0.0)))
    return b.select(time, key, weight.alias("signal_weight"))


def weights_on_grid(weights: DataFrame, grid: DataFrame, tolerance: str, value: str = "signal_weight") -> DataFrame:
    """Every identifier's weight at each time of the grid: the weights set last, all at once, while younger than tolerance.

    What counts is the last time at which any identifier had weights; identifiers without one then weigh 0.
    """
    from .fill import asof

    stamps = weights.select(TIME).distinct().select(TIME, F.col(TIME).alias("set_at"), F.lit("all").alias("_k"))
    at = asof(grid.select(TIME, F.lit("all").alias("_k")), stamps, ["set_at"], ["_k"], tolerance=tolerance).where(F.col("set_at").isNotNull())
    names = weights.select(KEY).distinct()
    cells = at.select(F.col(TIME).alias("_at"), F.col("set_at").alias(TIME)).crossJoin(names)
    made = cells.join(weights.select(TIME, KEY, value), [TIME, KEY], "left").select(F.col("_at").alias(TIME), KEY, F.coalesce(value, F.lit(0.0)).alias(value))
    return made
