"""Passes over the rows of a key in time order, for what windows of Spark can't do in one step a row.

Spark deals rows by key and sorts them in a task; they then stream through it in Arrow batches, many keys in one, and numpy or pandas
works on a batch at once. What a pass carries from batch to batch is bounded: the state of a recurrence, or the last n - 1 rows of a
window. No key is held whole. Where one key has more rows than a task should see, recurrences take a ``chunk``, a column that cuts
keys along time: chunks are scanned apart, their totals composed in order, and each is scanned again from the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEY, TIME

Step = Callable[[list[np.ndarray], np.ndarray], list]


def starts(columns: Sequence[pa.Array], last: Sequence | None) -> np.ndarray:
    """Which rows begin a group of equal columns; last: the row before the first one."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for i, c in enumerate(columns):
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            apart = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            out[1:] |= apart
        if n and (last is None or c[0].as_py() != last[i]):
            out[0] = True
    return out


def doubles(c: pa.Array) -> np.ndarray:
    """A column of doubles; null is NaN."""
    return pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False)


def nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def ordered_pass(df: DataFrame, inputs: Sequence[Column], added: Sequence[T.StructField], make: Callable[[], Step], keys: Sequence[str] = (KEY,), time: str = TIME, order: Sequence[str] = (), drops: bool = False) -> DataFrame:
    """df with the added columns, which ``make()`` computes: a function of the inputs (doubles, null as NaN) and of which rows begin a key.

    It is called for one batch after the other and may keep a state between them. Ties in time are ordered by ``order``. A column of df that has an added
    column's name is replaced. With ``drops`` it returns which rows stay before the columns, and columns of those rows only.
    """
    gone = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in gone]
    names, k = [f.name for f in kept], len(inputs)
    # rows are dealt before inputs and keys are set beside them, which would be shuffled twice
    dealt = df.repartition(*(F.col(f"`{c}`") for c in keys))
    wide = dealt.select(*(F.col(f"`{c}`") for c in names), *(c.cast("double").alias(f"in {i}") for i, c in enumerate(inputs)), *(F.col(f"`{c}`").alias(f"key {i}") for i, c in enumerate(keys)), F.col(f"`{time}`").alias("at"), *(F.col(f"`{c}`").alias(f"tie {i}") for i, c in enumerate(order)))
    by = [f"key {i}" for i in range(len(keys))]
    wide = wide.sortWithinPartitions(*by, "at", *(f"tie {i}" for i in range(len(order)))).drop("at", *(f"tie {i}" for i in range(len(order))))

    def run(batches: Iterator[pa.RecordBatch]):
        step, last = make(), None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.columns[len(names) + k :]
            made = step([doubles(c) for c in b.columns[len(names) : len(names) + k]], starts(own, last))
            last = [c[-1].as_py() for c in own]
            through = b.columns[: len(names)]
            if drops:
                stay, *made = made
                through = [c.filter(pa.array(stay)) for c in through]
            yield pa.RecordBatch.from_arrays([*through, *(nullable(x) if isinstance(x, np.ndarray) else x for x in made)], names=[*names, *(f.name for f in added)])

    return wide.mapInArrow(run, T.StructType([*kept, *added]))


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


# -- order statistics of sliding windows


class _Bounds(BaseIndexer):
    """Windows from given rows up to each row."""

    def __init__(self, first: np.ndarray):
        super().__init__()
        self.first = first

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first, np.arange(1, num_values + 1, dtype=np.int64)


class Windows:
    """The rows of a batch after the last rows of the batch before, as far as windows of n rows reach."""

    def __init__(self, n: int):
        self.n, self.held, self.key = n, None, np.zeros(0, np.int64)

    def take(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """x (rows first) with what was held before it; the first row of each row's key; how many rows were held."""
        old = 0 if self.held is None or begins[0] else len(self.held)
        every = x if not old else np.concatenate([self.held, x])
        mark = np.concatenate([np.zeros(old, bool), begins])
        first = np.maximum.accumulate(np.where(mark, np.arange(len(every)), 0))
        self.held = every[max(first[-1], len(every) - (self.n - 1)) :] if self.n > 1 else every[:0]
        return every, first, old


class Fill:
    """The last known value of a key; before there is one, a given value."""

    def __init__(self):
        self.last = np.nan

    def take(self, x: np.ndarray, begins: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        x = x.copy()
        if not begins[0] and np.isnan(x[0]):
            x[0] = self.last
        # the last known row, or the key's first one
        at = np.maximum.accumulate(np.where(~np.isnan(x) | begins, np.arange(len(x)), 0))
        out = x[at]
        self.last = out[-1]
        return out if first is None else np.where(np.isnan(out), first, out)


class Lag:
    """The row before, within a key."""

    def __init__(self):
        self.last = np.nan

    def take(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = np.where(begins, np.nan, np.append(self.last, x[:-1]))
        self.last = x[-1]
        return out


class Cells:
    """Which of a key's rows are cells of a grid, and which cell is its first; other rows only bring values."""

    def __init__(self):
        self.met = False

    def take(self, cell: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For the rows that are cells: whether each is the first one of its key."""
        key = np.cumsum(begins)
        mine = key[cell]
        out = np.append(True, mine[1:] != mine[:-1]) if len(mine) else np.zeros(0, bool)
        if len(mine) and mine[0] == 0:  # the key goes on from the batch before
            out[0] = not self.met
        self.met = bool(len(mine) and mine[-1] == key[-1]) or (self.met and key[-1] == 0)
        return out


def medians(x: np.ndarray, begins: np.ndarray, windows: Windows) -> np.ndarray:
    every, first, old = windows.take(x, begins)
    low = np.maximum(first, np.arange(len(every)) - windows.n + 1).astype(np.int64)
    return pd.Series(every).rolling(_Bounds(low), min_periods=1).median().to_numpy()[old:]


def means(x: np.ndarray, begins: np.ndarray, windows: Windows) -> np.ndarray:
    """Means over up to the last n rows."""
    every, first, old = windows.take(x, begins)
    stop = np.arange(len(every)) + 1
    low = np.maximum(first, stop - windows.n)
    sums = np.append(0.0, np.cumsum(every))
    return ((sums[stop] - sums[low]) / (stop - low))[old:]


def rolling_medians(df: DataFrame, made: Mapping[str, tuple[Column, int]], keys: Sequence[str] = (KEY,), time: str = TIME, order: Sequence[str] = ()) -> DataFrame:
    """Adds medians of the non-null values among the last n rows of a key: name -> (column, n); null where there is none.

    All in one pass; each window is a sorted list to which a row is added and from which one goes, n log n for n rows.
    """
    sizes = [n for _, n in made.values()]

    def make() -> Step:
        windows = [Windows(n) for n in sizes]
        return lambda x, begins: [medians(v, begins, w) for v, w in zip(x, windows, strict=True)]

    return ordered_pass(df, [c for c, _ in made.values()], [double(n) for n in made], make, keys, time, order)


# -- exponential weights


def affine_scan(c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y[i] = c[i] * y[i - 1] + b[i] from y = 0: (products of c up to i, y). Maps are composed over distances that double."""
    c, b, s = c.copy(), b.copy(), 1
    while s < len(c):
        b[s:] = b[s:] + c[s:] * b[:-s]
        c[s:] = c[s:] * c[:-s]
        if not c[s:].any():
            break
        s *= 2
    return c, b


class Exponential:
    """State of one column: mean, deviation square and sum of squared weights over the values so far, rows since the last one."""

    def __init__(self, span: float):
        self.a = 2.0 / (span + 1.0)
        self.reset()

    def reset(self) -> None:
        self.known, self.mean, self.var, self.w2, self.gap = False, 0.0, 0.0, 0.0, 0.0

    def step(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations at all rows. Weights fall with the rows between values, also with those that have none."""
        n, a = len(x), self.a
        if begins[0]:
            self.reset()
        key = np.cumsum(begins)
        seen = np.flatnonzero(~np.isnan(x))
        v = x[seen]
        first = np.append(True, key[seen[1:]] != key[seen[:-1]]) if len(seen) else np.zeros(0, bool)
        since = np.diff(seen, prepend=0).astype(float)
        goes_on = len(seen) > 0 and self.known and key[seen[0]] == key[0] and not begins[0]
        if goes_on:
            since[0], first[0] = self.gap + seen[0] + 1, False
        fade = (1 - a) ** since
        old = np.where(first, 0.0, fade / (fade + a))
        new = 1 - old
        before = self.mean if goes_on else 0.0
        c, b = old.copy(), new * v
        if goes_on:
            b[0] += old[0] * before
        if len(c):
            c[0] = 0.0
        mean = affine_scan(c, b)[1]
        was = np.append(before, mean[:-1]) if len(mean) else mean
        b = np.where(first, 0.0, old * (was - mean) ** 2 + new * (v - mean) ** 2)
        w = np.where(first, 1.0, new**2)
        if goes_on:
            b[0] += old[0] * self.var
            w[0] += old[0] ** 2 * self.w2
        var, w2 = affine_scan(c, b)[1], affine_scan(c * c, w)[1]
        # every row shows the state after the last value of its key
        at = np.cumsum(~np.isnan(x)) - 1
        there = (at >= 0) & (key[seen[np.maximum(at, 0)]] == key) if len(seen) else np.zeros(n, bool)
        at = np.maximum(at, 0)
        held = (key == key[0]) & ~there & self.known & (not begins[0])
        show = lambda y, old_value: np.where(there, y[at] if len(y) else np.nan, np.where(held, old_value, np.nan))
        m, s, q = show(mean, self.mean), show(var, self.var), show(w2, self.w2)
        with np.errstate(invalid="ignore", divide="ignore"):
            sd = np.where(q < 1, np.sqrt(np.maximum(s, 0.0) / (1 - q)), np.nan)
        self.known = not np.isnan(m[-1])
        if self.known:
            self.mean, self.var, self.w2 = float(m[-1]), float(s[-1]), float(q[-1])
            self.gap = float(n - 1 - seen[-1]) if there[-1] else self.gap + n
        return m, sd

    def total(self) -> list[float]:
        return [self.mean, self.var, self.w2, self.gap] if self.known else [float("nan")] * 4


class Totals:
    """What a chunk does to a state: its rows before the first value, that value, its weight at the end, and the state from that value on."""

    def __init__(self, span: float):
        self.scan = Exponential(span)
        self.lead, self.first, self.weight = 0.0, float("nan"), 1.0

    def step(self, x: np.ndarray, begins: bool) -> None:
        mark = np.zeros(len(x), bool)
        mark[0] = begins
        seen = np.flatnonzero(~np.isnan(x))
        gaps = np.diff(seen, prepend=-1).astype(float)
        if self.scan.known and len(seen):
            gaps[0] = self.scan.gap + seen[0] + 1
        if np.isnan(self.first):
            self.lead += float(seen[0] + 1 if len(seen) else len(x))
            if len(seen):
                self.first, gaps = float(x[seen[0]]), gaps[1:]
        fade = (1 - self.scan.a) ** gaps
        self.weight *= float(np.prod(fade / (fade + self.scan.a)))
        self.scan.step(x, mark)

    def after(self, state: list[float]) -> list[float]:
        """The state at the chunk's end when it begins from ``state`` (mean, variance, squared weights, rows since the last value)."""
        m0, var0, w20, gap = state
        if np.isnan(self.first):
            return [m0, var0, w20, gap + self.lead]
        if np.isnan(m0):
            return self.scan.total()
        fade = (1 - self.scan.a) ** (gap + self.lead)
        old, w, x1 = fade / (fade + self.scan.a), self.weight, self.first
        start, start_var, start_w2 = old * m0 + (1 - old) * x1, old * var0 + old * (1 - old) * (m0 - x1) ** 2, old**2 * w20 + (1 - old) ** 2
        mean, var, w2, tail = self.scan.total()
        # the first value's part gives way to a mixture of it and the state; the rest of the chunk stays
        rest = (mean - w * x1) / (1 - w) if w < 1 else 0.0
        return [mean + w * (start - x1), var + w * start_var + w * (1 - w) * (start - x1) * (start + x1 - 2 * rest), w2 + w * w * (start_w2 - 1), tail]


def exponential(df: DataFrame, made: Mapping[str, tuple[str, Column, float]], keys: Sequence[str] = (KEY,), time: str = TIME, order: Sequence[str] = (), chunk: Column | None = None) -> DataFrame:
    """Adds means and deviations with exponential weights: name -> ("mean" or "std", column, span), exact from a key's first row on.

    A new value weighs 2 / (span + 1) against what is known, which fades with every row, also with rows without a value; those show
    the value before. Deviations are corrected for bias and null until there are two values; nothing is adjusted for
    a beginning. chunk: a column that doesn't fall along time within a key; the rows of a key then pass through as many tasks as it has values.
    """
    kinds = [k for k, _, _ in made.values()]
    spans = [s for _, _, s in made.values()]
    if set(kinds) - {"mean", "std"}:
        raise ValueError(f"mean or std: {kinds}")
    inputs, added = [c for _, c, _ in made.values()], [double(n) for n in made]
    if chunk is None:

        def make() -> Step:
            scans = [Exponential(s) for s in spans]
            return lambda x, begins: [s.step(v, begins)[k == "std"] for s, v, k in zip(scans, x, kinds, strict=True)]

        return ordered_pass(df, inputs, added, make, keys, time, order)
    return _chunked(df, inputs, added, kinds, spans, keys, time, order, chunk)


def _chunked(df, inputs, added, kinds, spans, keys, time, order, chunk) -> DataFrame:
    names, n = [c for c in df.columns if c not in {f.name for f in added}], len(spans)
    key_cols = [F.col(f"`{c}`").alias(f"key {i}") for i, c in enumerate(keys)]
    ties = [F.col(f"`{c}`").alias(f"tie {i}") for i, c in enumerate(order)]
    by, sort = [f"key {i}" for i in range(len(keys))], ["at", *(f"tie {i}" for i in range(len(order)))]
    xs = [f"in {i}" for i in range(n)]
    made = [c.cast("double").alias(x) for c, x in zip(inputs, xs, strict=True)]
    states = ", ".join([f"`{k}` {df.schema[c].dataType.simpleString()}" for k, c in zip(by, keys, strict=True)] + [f"chunk {df.select(chunk).schema[0].dataType.simpleString()}", "state array<double>"])
    slim = df.select(*key_cols, chunk.alias("chunk"), F.col(f"`{time}`").alias("at"), *ties, *made).repartition(*by, "chunk").sortWithinPartitions(*by, "chunk", *sort).drop(*sort)

    def out(rows, like):
        at = list(zip(*rows, strict=True)) if rows else [[]] * (len(by) + 2)
        return pa.RecordBatch.from_arrays([pa.array(x, like.schema.field(i).type) for i, x in enumerate(at[:-1])] + [pa.array(at[-1], pa.list_(pa.float64()))], names=[*by, "chunk", "state"])

    def total(batches):
        """Per chunk: lead, first, weight and total of every column, flat."""
        now, name, b = None, None, None
        for b in batches:
            own = b.columns[: len(by) + 1]
            cut = np.append(np.flatnonzero(starts(own, name)), b.num_rows)
            x, rows = [doubles(b.column(c)) for c in xs], []
            if cut[0] > 0:
                for t, v in zip(now, x, strict=True):
                    t.step(v[: cut[0]], False)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if now is not None:
                    rows.append((*name, flat(now)))
                name, now = [c[int(lo)].as_py() for c in own], [Totals(s) for s in spans]
                for t, v in zip(now, x, strict=True):
                    t.step(v[lo:hi], True)
            yield out(rows, b)
        if now is not None:
            yield out([(*name, flat(now))], b)

    flat = lambda now: [y for t in now for y in (t.lead, t.first, t.weight, *t.scan.total())]

    def compose(batches):
        """Per chunk: the state of every column before it."""
        last, state = None, None
        for b in batches:
            rows = []
            for *name, mine in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name[:-1] != last:
                    last, state = name[:-1], [[float("nan")] * 3 + [0.0] for _ in spans]
                rows.append((*name, [y for s in state for y in s]))
                for i, span in enumerate(spans):
                    t = Totals(span)
                    t.lead, t.first, t.weight, *own = mine[7 * i : 7 * i + 7]
                    t.scan.known = not np.isnan(own[0])
                    if t.scan.known:
                        t.scan.mean, t.scan.var, t.scan.w2, t.scan.gap = own
                    state[i] = t.after(state[i])
            yield out(rows, b)

    totals = slim.mapInArrow(total, states)
    before = totals.repartition(*by).sortWithinPartitions(*by, "chunk").mapInArrow(compose, states)

    full = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *key_cols, chunk.alias("chunk"), F.col(f"`{time}`").alias("at"), *ties, *made, F.lit(None).cast("array<double>").alias("state"))
    both = full.unionByName(before, allowMissingColumns=True).withColumn("real", F.col("row").isNotNull())
    both = both.repartition(*by, "chunk").sortWithinPartitions(*by, "chunk", "real", *sort).select("row.*", *xs, *by, "chunk", "state", "real")
    schema = T.StructType([*(df.schema[c] for c in names), *added])

    def scan(batches):
        scans, last = [Exponential(s) for s in spans], None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.columns[len(names) + n : len(names) + n + len(by) + 1]
            real, state = b.column("real").to_numpy(zero_copy_only=False), b.column("state")
            begins = starts(own, last)
            last = [c[-1].as_py() for c in own]
            # a chunk's state comes before its rows, which are scanned on from it
            cut = np.append(np.flatnonzero(begins), b.num_rows)
            x, done = [doubles(c) for c in b.columns[len(names) : len(names) + n]], [[np.zeros(0)] for _ in spans]
            parts = [(0, int(cut[0]))] if cut[0] > 0 else []
            for lo, hi in [*parts, *zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]:
                if begins[lo]:
                    for i, s in enumerate(scans):
                        s.mean, s.var, s.w2, s.gap = (y.as_py() for y in state[lo].values[4 * i : 4 * i + 4])
                        s.known = not np.isnan(s.mean)
                    lo += 1
                if hi > lo:
                    for i, s in enumerate(scans):
                        done[i].append(s.step(x[i][lo:hi], np.zeros(hi - lo, bool))[kinds[i] == "std"])
            keep = pa.array(real)
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in b.columns[: len(names)]), *(nullable(np.concatenate(d)) for d in done)], names=[*names, *(f.name for f in added)])

    return both.mapInArrow(scan, schema)
