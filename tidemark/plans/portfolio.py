"""A portfolio from its declaration: signal, prices, rebalancing, returns, values, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fill, portfolio, signals
from ..schema import KEY, TIME


@dataclass(frozen=True)
class PortfolioConfig:
    signal: str = "market_cap"
    signal_options: Mapping = field(default_factory=dict)
    rebalance: str = "immediate"
    fee: float = 0.0
    #: A weight counts while less than this has passed since it was set.
    forward_fill: str = "1 DAY"
    price: str = "close"
    start_value: float = 1.0
    override_asset: str | None = None
    resample: str | None = None

    @classmethod
    def of(cls, document: Mapping) -> PortfolioConfig:
        """From a mapping, such as a parsed YAML document; unknown names raise."""
        unknown = set(document) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        made = cls(**document)
        for kind, name, known in (("signal", made.signal, signals.REGISTRY), ("rebalance", made.rebalance, portfolio.REBALANCERS)):
            if name not in known:
                raise ValueError(f"no {kind} named {name}; there are {sorted(known)}")
        return made


def weights_of(config: PortfolioConfig, *inputs) -> DataFrame:
    """The signal's weights from its own inputs (a history, prices, a grid)."""
    return signals.REGISTRY[config.signal](*inputs, **config.signal_options)


def build(config: PortfolioConfig, weights: DataFrame, prices: DataFrame, grid: DataFrame, seed: DataFrame | None = None, last_close: float | None = None, keep_maps: bool = True) -> DataFrame:
    """(time_index, close, return, six JSON maps, last_rebalance_date, close_time) on the grid.

    Weights go to the grid while they are valid; prices and volumes are as of the grid; what is rebalanced earns the
    returns. An update continues from seed, the last stored weights, price and volume of each identifier with its time,
    and last_close.
    """
    on_grid = signals.weights_on_grid(weights, grid, config.forward_fill)
    known = prices.select(TIME, KEY, F.col(config.price).alias("price"), "volume")
    frame = fill.asof(on_grid, known, ["price", "volume"]).select(TIME, KEY, F.col("signal_weight").alias("weights"), "price", "volume")
    moved = portfolio.REBALANCERS[config.rebalance](frame) if seed is None or config.rebalance != "immediate" else portfolio.immediate(frame, seed)
    returns = portfolio.portfolio_returns(moved, prices, config.fee, price=config.price)
    out = portfolio.portfolio_values(returns, config.start_value if last_close is None else last_close)
    if keep_maps:
        out = portfolio.serialized(out, moved)
    out = out.withColumn("close_time", F.date_format(TIME, "yyyy-MM-dd HH:mm:ss"))
    if config.override_asset:
        out = portfolio.override_close(out, prices, config.override_asset, config.price)
    if config.resample:
        values = [c for c in out.columns if c != TIME]
        out = fill.resample_last(out.withColumn("_k", F.lit(0)), config.resample, values, ("_k",)).drop("_k")
    return out
