"""Rolling models. A window is never gathered: its sums of products are differences of running sums over a batch of rows, and a batch of
windows is solved at once on (rows, k, k) arrays. No key is held whole by a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEY, TIME
from .fill import asof
from .passes import Windows, double, ordered_pass


def coordinate_descent(g: np.ndarray, c: np.ndarray, l1: float, l2: float, nonnegative: bool, tolerance: float = 1e-10, rounds: int = 2000) -> np.ndarray:
    """Minimises 1/2 b'gb - c'b + l1 |b|_1 + l2/2 |b|^2 for many (g, c) at once, (rows, k, k) and (rows, k), with b >= 0 if asked for.

    Coordinates are taken in turn over all rows that still move. Every few rounds the equations of the coordinates that are not zero are
    solved at once; where that solution keeps its signs and satisfies the conditions of the others, it is the minimum.
    """
    rows, k = c.shape
    b = np.zeros_like(c)
    diagonal = np.einsum("njj->nj", g) + l2
    free = diagonal > 0
    left = np.arange(rows)
    for turn in range(rounds):
        moved = np.zeros(len(left))
        for j in range(k):
            r = c[left, j] - np.einsum("nj,nj->n", g[left, j], b[left]) + g[left, j, j] * b[left, j]
            new = np.sign(r) * np.maximum(np.abs(r) - l1, 0.0) / np.where(free[left, j], diagonal[left, j], 1.0)
            new = np.where(free[left, j], np.maximum(new, 0.0) if nonnegative else new, 0.0)
            moved = np.maximum(moved, np.abs(new - b[left, j]))
            b[left, j] = new
        left = left[moved >= tolerance]
        if turn % 8 == 7 and len(left):
            left = left[~_finish(g, c, b, left, l1, l2, nonnegative, free)]
        if not len(left):
            break
    return b


def _finish(g, c, b, left, l1, l2, nonnegative, free) -> np.ndarray:
    """Solves for the coordinates that are not zero; where that is the minimum b takes it. Returns where."""
    k = c.shape[1]
    used = (b[left] != 0) & free[left]
    eye = np.eye(k)
    m = np.where(used[:, :, None] & used[:, None, :], g[left] + l2 * eye, eye)
    sign = np.sign(b[left])
    # a singular system stays with the descent
    sound = np.abs(np.linalg.det(m / np.maximum(np.abs(m).max((1, 2), keepdims=True), 1e-300))) > 1e-14
    x = np.zeros_like(b[left])
    x[sound] = np.linalg.solve(m[sound], np.where(used, c[left] - l1 * sign, 0.0)[sound][:, :, None])[:, :, 0]
    slope = c[left] - np.einsum("njk,nk->nj", g[left], x) - l2 * x
    scale = 1e-9 * (1 + np.abs(c[left]).max(1, keepdims=True))
    rest = slope <= l1 + scale if nonnegative else np.abs(slope) <= l1 + scale
    good = sound & np.where(used, x * sign > 0, rest | ~free[left]).all(1)
    b[left[good]] = x[good]
    return good


class Moments:
    """Sums over the last n rows of a key, for every row of a batch. Windows are put together from sums over 1, 2, 4, ... rows, so that nothing is
    subtracted: large values elsewhere, in other keys too, take no digits from a window."""

    def __init__(self, n: int, inclusive: bool = True):
        self.n, self.inclusive, self.windows = n, inclusive, Windows(n + 1)

    def take(self, x: np.ndarray, begins: np.ndarray, centred: bool = False):
        """Returns (add, full, shift): add(make) sums make(rows) over each row's window; full tells windows of n rows, others have no meaning.

        With ``centred`` rows are taken relative to a row of their key, which leaves covariances as they are: shift, for each row.
        """
        every, first, old = self.windows.take(x, begins)
        shift = np.nan_to_num(every[first]) if centred else np.zeros_like(every)
        stop = np.arange(old, len(every)) + self.inclusive
        full = stop - np.maximum(first[old:], stop - self.n) == self.n
        every = every - shift

        def add(make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            power = make(every)
            out, offset, size = np.zeros((len(power) + 1, *power.shape[1:])), 0, 1
            while size <= self.n:
                if self.n & size:
                    out[offset + 1 :] += power[: len(power) - offset]
                    offset += size
                power = power.copy()
                power[size:] = power[size:] + power[:-size]
                size *= 2
            return out[stop]

        return add, full, shift[old:]


def _gram(x: np.ndarray, begins: np.ndarray, moments: Moments, centred: bool = False):
    """(count of rows with y, sums of v v' and of v over them for v = (y, factors), missing values of factors among them, full windows, shift)."""

    def with_y(rows: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(rows[:, :1]), np.where(np.isfinite(rows), rows, 0.0), 0.0)

    add, full, shift = moments.take(x, begins, centred)
    n = add(lambda r: np.isfinite(r[:, :1]).astype(float))[:, 0]
    gram = add(lambda r: (v := with_y(r))[:, :, None] * v[:, None, :])
    missing = add(lambda r: (np.isfinite(r[:, :1]) & ~np.isfinite(r)).astype(float))
    return n, gram, add(with_y), missing, full, shift


def _lists(x: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, null where there is none."""
    width = x.shape[1]
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()), mask=pa.array(~there))


def _double(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _map(names: list[str], values: str) -> Column:
    return F.when(F.col(values).isNotNull(), F.map_from_arrays(F.array(*map(F.lit, names)), values))


def rolling_regression(df: DataFrame, y: str, factors: list[str], n: int, alpha: float = 0.0, l1_ratio: float = 1.0, nonnegative: bool = True, key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds weights, map factor -> coefficient, fitted on the last n rows, the current one included; null before n rows.

    alpha 0 is non-negative least squares, l1_ratio 1 the lasso, between 0 and 1 the elastic net; there is no
    intercept. A factor with a missing value in the window has coefficient 0; rows without y are left out. Rolling sums of products
    stand for the windows: a batch holds (rows, k, k) of them, for k factors, whatever n is.
    """

    def make():
        moments = Moments(n)

        def step(x, begins):
            count, gram, _, missing, full, _ = _gram(np.column_stack(x), begins, moments)
            per = np.maximum(count, 1)[:, None, None]
            known = missing[:, 1:] == 0
            g = np.where(known[:, :, None] & known[:, None, :], gram[:, 1:, 1:] / per, 0.0)
            c = np.where(known, gram[:, 1:, 0] / per[:, :, 0], 0.0)
            b = np.zeros_like(c)
            b[full] = coordinate_descent(g[full], c[full], alpha * l1_ratio, alpha * (1 - l1_ratio), nonnegative)
            return [_lists(b, full)]

        return step

    made = ordered_pass(df, [_double(y), *map(_double, factors)], [T.StructField("_w", T.ArrayType(T.DoubleType()))], make, (key,), time)
    return made.withColumn("weights", _map(factors, "_w")).drop("_w")


def rolling_pca(df: DataFrame, columns: list[str], n: int, components: int = 1, inclusive: bool = True, key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds loadings, map column -> weight in the first component over the last n rows, and components, an array of
    (variance, loadings) of the largest ``components``, in the order of variance; null before n rows.

    Loadings are divided by the sum of their absolute values and have a sum that isn't negative. Missing values count as 0.
    inclusive: whether the window ends with the row or before it. Of components of equal variance any basis may come out.
    """
    k = min(components, len(columns), n)

    def make():
        moments = Moments(n, inclusive)

        def step(x, begins):
            x = np.nan_to_num(np.column_stack(x), nan=0.0, posinf=0.0, neginf=0.0)
            add, full, _ = moments.take(x, begins, centred=True)
            mean = add(lambda r: r) / n
            cov = add(lambda r: r[:, :, None] * r[:, None, :]) / n - mean[:, :, None] * mean[:, None, :]
            cov[~full] = 0.0
            values, vectors = np.linalg.eigh(cov)
            values, vectors = np.maximum(values[:, ::-1][:, :k], 0.0) * n / max(n - 1, 1), np.swapaxes(vectors[:, :, ::-1][:, :, :k], 1, 2)
            vectors = vectors / np.maximum(np.abs(vectors).sum(2, keepdims=True), 1e-300)
            vectors *= np.where(vectors.sum(2, keepdims=True) < 0, -1.0, 1.0)
            return [_lists(values, full), _lists(vectors.reshape(len(x), -1), full)]

        return step

    lists = T.ArrayType(T.DoubleType())
    made = ordered_pass(df, list(map(_double, columns)), [T.StructField("_v", lists), T.StructField("_w", lists)], make, (key,), time)
    each = F.array(*(F.struct(F.get("_v", F.lit(i)).alias("variance"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.slice("_w", i * len(columns) + 1, len(columns))).alias("loadings")) for i in range(k)))
    made = made.withColumn("components", F.when(F.col("_v").isNotNull(), each))
    return made.withColumn("loadings", F.get("components", F.lit(0))["loadings"]).drop("_v", "_w")


@dataclass(frozen=True)
class LinearModel:
    """What is fitted: least squares with penalties on the coefficients, with or without an intercept."""

    alpha: float = 0.0
    l1_ratio: float = 0.5
    intercept: bool = True
    nonnegative: bool = False
    #: Added to the diagonal, in units of the mean of squares.
    ridge: float = 0.0

    def fit(self, n: np.ndarray, gram: np.ndarray, sums: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Intercept and coefficients, (rows, 1 + k), from counts, sums of v v' and of v over v = (target, features) less the shift."""
        per = np.maximum(n, 1)
        mean = sums / per[:, None] if self.intercept else np.zeros_like(sums)
        m = gram / per[:, None, None] - mean[:, :, None] * mean[:, None, :]
        g, c = m[:, 1:, 1:], m[:, 1:, 0]
        b = coordinate_descent(g, c, self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio) + self.ridge, self.nonnegative)
        mean = mean + shift
        return np.column_stack([mean[:, 0] - np.einsum("nk,nk->n", mean[:, 1:], b), b])


def rolling_predict(df: DataFrame, y: str, features: list[str], n: int, ridge: float = 1e-8, model: LinearModel | None = None, key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds predicted: a linear model fitted on the n rows before, applied to the row. Null before n rows or
    with a missing feature; rows of the window with a missing value are left out."""
    model = model or LinearModel(ridge=ridge)

    def make():
        moments = Moments(n, inclusive=False)

        def step(x, begins):
            now = np.column_stack(x)
            whole = np.where(np.isfinite(now).all(1, keepdims=True), now, np.nan)
            count, gram, sums, _, full, shift = _gram(whole, begins, moments, model.intercept)
            ok = full & (count > 0) & np.isfinite(now[:, 1:]).all(1)
            out = np.full(len(now), np.nan)
            if ok.any():
                b = model.fit(count[ok], gram[ok], sums[ok], shift[ok])
                out[ok] = b[:, 0] + np.einsum("nk,nk->n", b[:, 1:], now[ok, 1:])
            return [out]

        return step

    return ordered_pass(df, [_double(y), *map(_double, features)], [double("predicted")], make, (key,), time)


def fit_schedule(df: DataFrame, y: str, features: list[str], n: int, refit: Column, model: LinearModel | None = None, key: str = KEY, time: str = TIME) -> DataFrame:
    """Models fitted once per refit: (time, key, last_timestamp_on_train, n_train, intercept, coefficients), a training log.

    refit: a column that doesn't fall along time, such as the number of a week; a key is fitted anew at its first row of each value, on the
    n rows before that row. Rows with a missing value don't count; before n rows, or without any that counts, no
    model comes out. The models of a batch's refits are solved at once; other rows only add to rolling sums.
    """
    model = model or LinearModel()
    period = refit.cast("double")
    seconds = F.unix_micros(F.col(f"`{time}`").cast("timestamp")) / 1e6
    fields = [double("n_train"), double("_trained"), T.StructField("_b", T.ArrayType(T.DoubleType()))]

    def make():
        moments, last = Moments(n, inclusive=False), [np.nan, np.nan]

        def step(x, begins):
            now = np.column_stack(x[2:])
            whole = np.where(np.isfinite(now).all(1, keepdims=True), now, np.nan)
            count, gram, sums, _, full, shift = _gram(whole, begins, moments, model.intercept)
            due = begins | (x[0] != np.append(last[0], x[0][:-1]))
            before = np.append(last[1], x[1][:-1])
            last[:] = x[0][-1], x[1][-1]
            ok = due & full & (count > 0)
            b = np.zeros((len(now), 1 + len(features)))
            if ok.any():
                b[ok] = model.fit(count[ok], gram[ok], sums[ok], shift[ok])
            return [np.where(ok, count, np.nan), np.where(ok, before, np.nan), _lists(b, ok)]

        return step

    made = ordered_pass(df.select(time, key, y, *features), [period, seconds, _double(y), *map(_double, features)], fields, make, (key,), time).where("_b IS NOT NULL")
    trained = F.timestamp_micros(F.round(F.col("_trained") * 1e6).cast("long")).cast(df.schema[time].dataType)
    return made.select(time, key, trained.alias("last_timestamp_on_train"), F.col("n_train").cast("long"), F.get("_b", F.lit(0)).alias("intercept"), F.map_from_arrays(F.array(*map(F.lit, features)), F.slice("_b", 2, len(features))).alias("coefficients"))


def predict(df: DataFrame, models: DataFrame, features: list[str], key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds predicted, from the last model of the key at or before each row, and fitted_at, when that was fitted. Null without a model or with a missing feature."""
    at = asof(df.withColumn("_row", F.struct(*df.columns)).select(time, key, "_row"), models, ["intercept", "coefficients"], (key,), time, source_time="fitted_at")
    value = F.col("intercept")
    for f in features:
        value = value + F.col("coefficients")[f] * F.col(f"_row.{f}").cast("double")
    return at.withColumn("predicted", value).select("_row.*", "predicted", "fitted_at")


def training_table(features: DataFrame, prices: DataFrame, names: list[str], price: str = "close", key: str = KEY, time: str = TIME, keep_null: bool = False) -> DataFrame:
    """Features of a row joined to target, the return that the identifier's next row brings.

    Rows without a target, or with a missing feature, are left out unless asked for: they can't train a model.
    """
    w = Window.partitionBy(key).orderBy(time)
    ahead = prices.select(time, key, F.when(F.col(price) != 0, F.lead(price).over(w) / F.col(price) - 1).alias("target"))
    out = features.select(time, key, *names).join(ahead, [time, key], "left" if keep_null else "inner")
    return out if keep_null else out.dropna(subset=[*names, "target"])
