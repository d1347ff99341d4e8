"""Streams that carry state: gaps of bars are filled as event time passes, from the last bar that is kept for each key."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import minutes
from ..schema import KEY, TIME

VALUES = ("open", "high", "low", "close", "volume", "trade_count", "vwap")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the last bars of a key leave behind, as JSON; a bar waits as microseconds since 1970 and JSON of its values.
CARRY, WAITING = "carry string", "at long, bar string"


class Session:
    """What is carried for a key: the last close and vwap, and the session that is open: its bounds, the next cell of its grid, and its bars
    as long as none of them is whole. Times are microseconds since 1970."""

    def __init__(self, step: int, known: dict | None = None):
        self.step = step
        self.at = known or {"close": None, "vwap": None, "open": None, "end": None, "next": None, "whole": False, "held": []}

    def take(self, at: int, bar: dict, bounds: tuple[int, int]) -> Iterator[tuple]:
        """Rows that are certain once the bar at this time is known; bars come in order."""
        x = self.at
        if x["open"] != bounds[0]:
            yield from self._leave()
            x.update({"open": bounds[0], "end": bounds[1], "next": bounds[0], "whole": False, "held": []})
        x["held"].append((at, bar))
        x["whole"] = x["whole"] or all(bar.get(c) is not None for c in VALUES[:4])
        if x["whole"]:
            for at, bar in x["held"]:
                yield from self._gaps(at)
                on_grid = x["next"] == at
                missing = self._carry(bar)
                if on_grid:
                    x["next"] += self.step
                    if x["close"] is not None:
                        flat = {c: x["close"] for c in VALUES[:3]} if missing else bar
                        yield (at, *(flat.get(c) for c in VALUES[:3]), x["close"], bar.get("volume") or 0.0, int(bar.get("trade_count") or 0), x["vwap"], missing)
            x["held"] = []

    def _carry(self, bar: dict) -> bool:
        for c in ("close", "vwap"):
            self.at[c] = self.at[c] if bar.get(c) is None else bar[c]
        return bar.get("close") is None

    def _gaps(self, to: int) -> Iterator[tuple]:
        x = self.at
        while x["next"] < to:
            if x["close"] is not None:
                yield (x["next"], *[x["close"]] * 4, 0.0, 0, x["vwap"], True)
            x["next"] += self.step

    def _leave(self) -> Iterator[tuple]:
        """The rest of a session's grid, once a bar of a later one is there; a session without a whole bar has none."""
        if self.at["open"] is not None and self.at["whole"]:
            yield from self._gaps(self.at["end"] + 1)
        for _, bar in self.at["held"]:
            self._carry(bar)


class GapFiller(StatefulProcessor):
    """Bars wait in state until the watermark has passed them, then take their place in the open session."""

    def __init__(self, step: int, kind: T.DataType):
        self.step, self.kind = step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", CARRY)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names of the interface)
        found = []
        for part in rows:
            for r in part.to_dict("records"):
                bar = {c: None if pd.isna(r[c]) else r[c] for c in VALUES if c in r}
                bounds = [int(pd.Timestamp(r[c]).value // 1000) for c in ("session_open", "session_close")]
                found.append((int(pd.Timestamp(r["bar_at"]).value // 1000), json.dumps([bar, bounds], default=float)))
        for x in found:
            self.waiting.appendValue(x)
        if found:
            self._wake(min(x[0] for x in found))
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer of one millisecond after the bar, so that bars of the same one are together."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((int(x[0]), x[1]) for x in self.waiting.get())
        ready = [x for x in every if x[0] < passed]
        later = every[len(ready) :]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        if not ready:
            return
        session = Session(self.step, json.loads(self.carry.get()[0]) if self.carry.exists() else None)
        out, last = [], None
        for at, text in ready:
            if at != last:  # of repeated bars the first by values
                bar, bounds = json.loads(text)
                out += session.take(at, bar, tuple(bounds))
            last = at
        self.carry.update((json.dumps(session.at),))
        if out:
            made = pd.DataFrame(out, columns=["bar_at", *VALUES, "interpolated"])
            made["bar_at"] = pd.to_datetime(made["bar_at"], unit="us")
            made.insert(0, "bar_key", key[0])
            yield made

    def close(self) -> None:
        pass


def fill_stream(bars: DataFrame, schedule: DataFrame, step: str, delay: str, key: str = KEY, time: str = TIME) -> DataFrame:
    """Gap-filled bars of a stream, as ``operators.bars.fill_intraday`` gives them for a table: (time, key, bar, interpolated), to be appended.

    A key's last bar, open session and the bars that the watermark has not passed are its state; a restarted stream goes on from it. Bars
    come out in the order of event time, once it has passed them by ``delay``; gaps before a bar come out with it, the rest
    of a session with the first bar of a later one, so the last session's grid ends at its last bar. Bars outside sessions, later than the watermark, or
    without a key are left out. The schedule is a calendar, one row a session, whose days are looked up by a broadcast join. State is kept
    by RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER``.
    """
    at = F.col(time).cast("timestamp")
    touched = F.explode(F.sequence(F.to_date("market_open"), F.to_date("market_close"))).alias("day")
    s = schedule.select(F.col("market_open").cast("timestamp").alias("session_open"), F.col("market_close").cast("timestamp").alias("session_close"), touched)
    values = [F.col(c).cast("double").alias(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in VALUES]
    rows = bars.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("bar_key"), at.alias("bar_at"), *values).withWatermark("bar_at", delay)
    rows = rows.join(F.broadcast(s), (F.to_date("bar_at") == F.col("day")) & F.col("bar_at").between(F.col("session_open"), F.col("session_close"))).drop("day")
    kind = "bar_key string, bar_at timestamp, " + ", ".join(f"{c} {'long' if c == 'trade_count' else 'double'}" for c in VALUES) + ", interpolated boolean"
    micros = int(timedelta(minutes=minutes(step)) / timedelta(microseconds=1))
    out = rows.groupBy("bar_key").transformWithStateInPandas(GapFiller(micros, bars.schema[key].dataType), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return out.select(F.col("bar_at").cast(bars.schema[time].dataType).alias(time), F.col("bar_key").alias(key), *VALUES, "interpolated")


def closing(bars: DataFrame, after: datetime, key: str = KEY, time: str = TIME) -> DataFrame:
    """One row of the empty key at a later time, outside all sessions: it moves the watermark past a stream's last bars and comes to nothing else."""
    kinds = {f.name: f.dataType for f in bars.schema.fields}
    return bars.sparkSession.range(1).select(*(F.lit(after).cast(kinds[c]).alias(c) if c == time else F.lit("" if c == key else None).cast(kinds[c]).alias(c) for c in bars.columns))
