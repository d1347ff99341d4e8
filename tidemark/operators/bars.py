"""Price bars: folds, sliding bars, gap filling on session grids."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_unit, interval, minutes
from ..schema import KEY, TIME, epoch_ns
from .fill import bfill, ffill
from .merge import keep_one

COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "trade_count", "vwap")


def vwap(price: str = "vwap", volume: str = "volume", last: Column | None = None) -> Column:
    """Aggregate: volume-weighted mean price; ``last`` where there is no volume."""
    v = F.sum(F.when(F.col(price).isNotNull(), F.col(volume)))
    mean = F.when(v != 0, F.sum(F.col(price) * F.col(volume)) / v)
    return F.coalesce(mean, last) if last is not None else mean


def fold(df: DataFrame, by: list, time: str = TIME, tie: tuple[str, ...] = ()) -> DataFrame:
    """One bar of each group: first open, last close, highest, lowest, summed volume, vwap. Partial sums are shuffled, not rows."""
    order = F.struct(time, *tie)
    close = F.max_by("close", order)
    made = [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), close.alias("close"), F.sum("volume").alias("volume")]
    if "vwap" in df.columns:
        made.append(vwap(last=close).alias("vwap"))
    if "trade_count" in df.columns:
        made.append(F.sum("trade_count").alias("trade_count"))
    return df.groupBy(*by).agg(*made)


def daily(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """First open and last close of each identifier and day."""
    return df.groupBy(key, F.to_date(time).alias("day")).agg(F.min_by("open", time).alias("open"), F.max_by("close", time).alias("close"))


def tick_bars(df: DataFrame, price: str, volume: Column | str, step: str, key: str = KEY, time: str = TIME, tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars of fixed steps from single observations, labelled by the step's start."""
    order = F.struct(time, *tie)
    v = F.col(volume) if isinstance(volume, str) else volume
    at = F.window(time, interval(step))["start"]
    return df.withColumn("_v", v).groupBy(key, at.alias("_at")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("_v").alias("volume"), F.count("*").alias("trade_count"),
        F.coalesce(F.when(F.sum("_v") != 0, F.sum(F.col(price) * F.col("_v")) / F.sum("_v")), F.max_by(price, order)).alias("vwap"),
    ).withColumnRenamed("_at", time)


def sliding(df: DataFrame, n: int, bar: str, key: str = KEY, time: str = TIME, schedule: DataFrame | None = None) -> DataFrame:
    """Bars over the last n rows, one row on at a time; the first n - 1 rows of a key have none.

    open_time is the first row's time less one bar. With a schedule, bars that end before the session's open plus
    their length, or after its close, are left out.
    """
    w = Window.partitionBy(key).orderBy(time)
    frame = w.rowsBetween(-(n - 1), 0)
    close = F.col("close")
    out = {
        "open": F.first("open").over(frame), "high": F.max("high").over(frame), "low": F.min("low").over(frame), "volume": F.sum("volume").over(frame),
        "_n": F.count(F.lit(1)).over(frame), "_first": F.first(time).over(frame),
    }
    if "vwap" in df.columns:
        v = F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))).over(frame)
        out["vwap"] = F.coalesce(F.when(v != 0, F.sum(F.col("vwap") * F.col("volume")).over(frame) / v), close)
    if "trade_count" in df.columns:
        out["trade_count"] = F.sum("trade_count").over(frame)
    bars = df.withColumns(out).where(F.col("_n") == n).withColumn("open_time", epoch_ns(F.col("_first") - F.expr(f"INTERVAL {interval(bar)}"))).drop("_n", "_first")
    if schedule is None:
        return bars
    s = schedule.select(F.col("session").alias("_s"), "market_open", "market_close")
    span = F.expr(f"INTERVAL {minutes(bar) * n} MINUTES")
    inside = bars.join(F.broadcast(s), F.to_date(time) == F.col("_s")).where((F.col(time) >= F.col("market_open") + span) & (F.col(time) <= F.col("market_close")))
    return inside.drop("_s", "market_open", "market_close")


def upsample(df: DataFrame, bar: str, to: str, **kwargs) -> DataFrame:
    """Sliding bars of length ``to`` from bars of length ``bar``; equal lengths leave the bars as they are."""
    n = minutes(to) // minutes(bar)
    return sliding(df, n, bar, **kwargs) if n > 1 else df


def infer_unit(df: DataFrame, column: str) -> DataFrame:
    """Unit of a column of epochs by the most frequent number of digits."""
    return df.where(F.col(column).isNotNull()).agg(F.mode(F.length(F.abs(F.col(column).cast("long")).cast("string")), True).alias("_n")).select(epoch_unit(F.col("_n")).alias("unit"))


def _repaired(df: DataFrame, keys: list[str], any_null: bool, lookahead: bool) -> DataFrame:
    """Fills grid rows from the last bar, flat at its close, and marks them interpolated: rows without a close, or with any_null without any value.

    Volume and trade count are 0 where they are missing, and stay where they aren't.
    """
    values = [c for c in COLUMNS if c in df.columns and c != "open_time"]
    empty = F.greatest(*(F.col(c).isNull().cast("int") for c in values)) == 1 if any_null else F.col("close").isNull()
    out = df.withColumn("interpolated", empty)
    carried = [c for c in ("close", "vwap") if c in values]
    filled = ffill(out, carried, keys)
    if lookahead:
        filled = bfill(filled, carried, keys)
    flat = {c: F.when(F.col("interpolated"), F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low") if c in values}
    none = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in ("volume", "trade_count") if c in values}
    return filled.withColumns(flat | none)


def fill_daily(bars: DataFrame, schedule: DataFrame, seed: DataFrame | None = None, parity: bool = True, key: str = KEY, time: str = TIME) -> DataFrame:
    """Bars at every session close from an identifier's first to its last bar; missing ones flat at the last close.

    seed holds each identifier's last stored bar and is not part of the result. Identifiers without a seed are also
    filled backward, which looks ahead. parity: a bar with any missing value counts as missing, not just without close.
    """
    known = bars if seed is None else bars.unionByName(seed, allowMissingColumns=True)
    bounds = bars.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    days = bounds.select(key, "_lo", "_hi", F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"))).alias("_day"))
    closes = schedule.select(F.to_date("market_close").alias("_day"), F.col("market_close").alias(time), F.col("market_open").alias("_open"))
    grid = days.join(F.broadcast(closes), "_day").where(F.col(time) <= F.col("_hi")).select(key, time, F.lit(True).alias("_close"), "_open")
    full = grid.join(known, [time, key], "full_outer")
    done = _repaired(full, [key], parity, seed is None).where(F.col("_close"))
    if seed is not None:
        done = done.join(seed.select(key, F.col(time).alias("_at")), key, "left").where(F.col("_at").isNull() | (F.col(time) > F.col("_at"))).drop("_at")
    if "open_time" in done.columns:
        done = done.withColumn("open_time", F.coalesce("open_time", epoch_ns(F.col("_open"))))
    return done.drop("_close", "_open")


def in_sessions(bars: DataFrame, schedule: DataFrame, time: str = TIME) -> DataFrame:
    """The bars inside a session, with _s, _open and _close of it: an equal join on the days that a session touches."""
    touched = F.explode(F.sequence(F.to_date("market_open"), F.to_date("market_close"))).alias("_day")
    s = schedule.select(F.col("session").alias("_s"), F.col("market_open").alias("_open"), F.col("market_close").alias("_close"), touched)
    return bars.join(F.broadcast(s), (F.to_date(time) == F.col("_day")) & F.col(time).between(F.col("_open"), F.col("_close"))).drop("_day")


def fill_intraday(bars: DataFrame, schedule: DataFrame, step: str | None, key: str = KEY, time: str = TIME) -> DataFrame:
    """A regular grid of ``step`` within each session that an identifier has a complete bar in; the last day's grid ends at its last bar.

    Repeated bars keep the first by values; gaps carry the last bar across days; a bar without close counts as missing.
    step None returns the bars in sessions unchanged. A key with a single bar at midnight passes through.
    """
    once = keep_one(bars, [F.struct(*(c for c in bars.columns if c not in (time, key)))], [time, key], last=False)
    marked = in_sessions(once, schedule, time)
    if step is None:
        return marked.drop("_s", "_open", "_close").withColumn("interpolated", F.lit(False))
    whole = F.lit(True)
    for c in ("open", "high", "low", "close"):
        whole = whole & F.col(c).isNotNull()
    days = marked.groupBy(key, "_s", "_open", "_close").agg(F.max(time).alias("_last"), F.max(whole.cast("int")).alias("_ok")).where("_ok = 1")
    latest = Window.partitionBy(key)
    days = days.withColumn("_end", F.when(F.col("_s") == F.max("_s").over(latest), F.col("_last")).otherwise(F.col("_close")))
    grid = days.select(key, F.explode(F.sequence("_open", "_end", F.expr(f"INTERVAL {interval(step)}"))).alias(time), F.lit(True).alias("_grid"))
    full = grid.join(marked.drop("_s", "_open", "_close"), [time, key], "full_outer")
    done = _repaired(full, [key], False, False).where(F.col("_grid") & F.col("close").isNotNull()).drop("_grid")
    lone = once.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where((F.col("_n") == 1) & (F.col(time) == F.date_trunc("day", time))).drop("_n")
    return done.unionByName(lone.join(done.select(key).distinct(), key, "left_anti").withColumn("interpolated", F.lit(False)), allowMissingColumns=True)


def interpolated_prices(bars: DataFrame, schedule: DataFrame, bar: str, to: str | None = None, since: DataFrame | None = None, key: str = KEY, time: str = TIME) -> DataFrame:
    """The whole node: fill, upsample, only rows after the watermarks ``since``, one row a key, fixed columns.

    Identifiers with one row at most are left out; missing volume is 0.
    """
    many = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n > 1").drop("_n")
    filled = fill_daily(many, schedule, key=key, time=time) if minutes(bar) >= 1440 else fill_intraday(many, schedule, bar, key=key, time=time)
    if to and minutes(to) > minutes(bar):
        marks = filled.select(time, key, "interpolated")
        filled = sliding(filled, minutes(to) // minutes(bar), bar, key=key, time=time).drop("interpolated").join(marks, [time, key])
    if since is not None:
        from .watermarks import newer

        filled = newer(filled, since, (key,), time)
    for c in ("vwap", "trade_count", "open_time"):
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit(None).cast("double" if c != "open_time" else "long"))
    filled = filled.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return filled.select(time, key, *COLUMNS, "interpolated")


def banded(start: datetime, end: datetime, months: int = 6):
    """[start, end) in bands of months, for sources that must be asked in pieces."""
    at = start
    while at < end:
        month = at.month - 1 + months
        nxt = at.replace(year=at.year + month // 12, month=month % 12 + 1, day=1)
        yield at, min(nxt, end)
        at = nxt
