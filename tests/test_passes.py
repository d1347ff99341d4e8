"""Passes over a key's rows against pandas and brute force: batches of a few rows, many keys, chunks, missing values, ties."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fill, models, passes, rolling, signals
from tidemark.schema import KEY, TIME

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark, seed=0, sizes=(40, 1, 3, 90, 25), missing=0.25, columns=("x", "z")):
    rng = np.random.default_rng(seed)
    rows = [(T0 + timedelta(hours=i), f"k{k}", *(None if rng.random() < missing else float(rng.normal() * 10 + 1e6) for _ in columns)) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(T0 + timedelta(hours=i), None, *(1.0 for _ in columns)) for i in range(3)] + [(T0 + timedelta(hours=i), "none", *(None for _ in columns)) for i in range(9)]
    return spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, " + ", ".join(f"{c} double" for c in columns))


def by_key(df):
    p = df.toPandas()
    p[KEY] = p[KEY].fillna("null")
    return {k: g.sort_values(TIME).reset_index(drop=True) for k, g in p.groupby(KEY)}


@pytest.mark.parametrize("chunk", [None, 1, 5, 1000])
def test_exponential(spark, chunk):
    """Exact from the first row on, whether a key is scanned at once, in chunks with few rows or none with values, or row by row."""
    df = frame(spark).withColumn("std", F.lit("replaced"))
    cut = None if chunk is None else F.floor(F.datediff(TIME, F.lit("2024-01-01")) * 24 / chunk + F.hour(TIME) / chunk)
    made = {"mean": ("mean", F.col("x"), 10.0), "std": ("std", F.col("x"), 10.0), "slow": ("std", F.col("z"), 60.0)}
    out = by_key(passes.exponential(df, made, chunk=cut))
    assert len(out) == 7 and sum(map(len, out.values())) == df.count()
    for g in out.values():
        w = g["x"].astype(float).ewm(span=10, adjust=False)
        assert np.allclose(g["mean"].astype(float), w.mean(), atol=1e-6, equal_nan=True)
        assert np.allclose(g["std"].astype(float), w.std(), atol=1e-5, equal_nan=True)
        assert np.allclose(g["slow"].astype(float), g["z"].astype(float).ewm(span=60, adjust=False).std(), atol=1e-5, equal_nan=True)
    assert passes.exponential(df.limit(0), made, chunk=cut).collect() == []
    with pytest.raises(ValueError, match="mean or std"):
        passes.exponential(df, {"a": ("median", F.col("x"), 3)})


def test_one_key_over_many_chunks(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000).cumsum())
    rows = [(T0 + timedelta(minutes=i), "hot", None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, x double")
    out = passes.exponential(df, {"s": ("std", F.col("x"), 500.0)}, chunk=F.date_trunc("hour", TIME)).orderBy(TIME)
    assert np.allclose([np.nan if r.s is None else r.s for r in out.collect()], pd.Series(x).ewm(span=500, adjust=False).std(), atol=1e-9, equal_nan=True)


def test_constant_series_have_no_deviation(spark):
    df = frame(spark, missing=0).withColumn("x", F.lit(1e9 + 0.1))
    got = {r.s for r in passes.exponential(df, {"s": ("std", F.col("x"), 20)}).collect()}
    assert got == {None, 0.0}


@pytest.mark.parametrize("n", [1, 2, 20, 1000])
def test_medians(spark, n):
    out = by_key(passes.rolling_medians(frame(spark), {"m": (F.col("x"), n), "m3": (F.col("z"), 3)}))
    for g in out.values():
        assert np.allclose(g["m"].astype(float), g["x"].astype(float).rolling(n, min_periods=1).median(), equal_nan=True)
        assert np.allclose(g["m3"].astype(float), g["z"].astype(float).rolling(3, min_periods=1).median(), equal_nan=True)


def test_ties_in_time_follow_the_order(spark):
    df = spark.createDataFrame([(T0, "a", float(i)) for i in range(30)], f"{TIME} timestamp_ntz, {KEY} string, x double")
    out = passes.rolling_medians(df.orderBy(F.rand(1)), {"m": (F.col("x"), 1)}, order=["x"]).collect()
    assert all(r.m == r.x for r in out)
    out = {r.x: r.m for r in passes.rolling_medians(df.orderBy(F.rand(2)), {"m": (F.col("x"), 3)}, order=["x"]).collect()}
    assert all(out[x] == x - 1 for x in out if x > 1)


def nnls_brute(x, y, l1=0.0, l2=0.0, nonnegative=True):
    """The least objective over all supports and signs."""
    n, k = x.shape
    g, c = x.T @ x / n, x.T @ y / n
    best, at = 0.0, np.zeros(k)
    for size in range(1, k + 1):
        for s in map(list, combinations(range(k), size)):
            for signs in [np.ones(size)] if nonnegative else [np.array([1.0 if b >> i & 1 else -1.0 for i in range(size)]) for b in range(1 << size)]:
                b = np.linalg.solve(g[np.ix_(s, s)] + l2 * np.eye(size), c[s] - l1 * signs)
                if (b * signs > 0).all():
                    f = b @ g[np.ix_(s, s)] @ b / 2 - c[s] @ b + l1 * np.abs(b).sum() + l2 / 2 * b @ b
                    if f < best:
                        best, at = f, np.zeros(k)
                        at[s] = b
    return at


@pytest.mark.parametrize(("alpha", "ratio", "nonnegative"), [(0.0, 1.0, True), (0.3, 1.0, True), (0.5, 0.4, True), (0.4, 0.5, False)])
def test_regressions_with_several_factors(spark, alpha, ratio, nonnegative):
    rng = np.random.default_rng(2)
    rows, names = [], ["f0", "f1", "f2", "f3"]
    for k, n in enumerate((60, 5, 45)):
        base = rng.normal(size=(n, 1))
        x = base + 0.4 * rng.normal(size=(n, 4))  # factors that go together
        y = x @ np.array([0.6, -0.3, 0.2, 0.0]) + 0.1 * rng.normal(size=n)
        for i in range(n):
            rows.append((T0 + timedelta(hours=i), f"k{k}", None if i % 11 == 5 else float(y[i]), *(None if (k, i, j) == (2, 20, 1) else float(x[i, j]) for j in range(4))))
    df = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, y double, " + ", ".join(f"{c} double" for c in names))
    out = by_key(models.rolling_regression(df, "y", names, 20, alpha, ratio, nonnegative))
    for g in out.values():
        for i, w in enumerate(g["weights"]):
            if i < 19:
                assert w is None
                continue
            part = g.iloc[i - 19 : i + 1]
            part = part[part["y"].notna()]
            known = [c for c in names if part[c].notna().all()]
            want = dict.fromkeys(names, 0.0) | dict(zip(known, nnls_brute(part[known].to_numpy(), part["y"].to_numpy(), alpha * ratio, alpha * (1 - ratio), nonnegative), strict=True))
            assert w == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("inclusive", [True, False])
def test_components(spark, inclusive):
    df = frame(spark, 4, missing=0.02, columns=("a", "b", "c", "d", "e"))
    names = ["a", "b", "c", "d", "e"]
    df = df.withColumns({c: F.coalesce(F.col(c) - 1e6, F.lit(None)) for c in names})
    out = by_key(models.rolling_pca(df, names, 12, components=4, inclusive=inclusive))
    for g in out.values():
        m = np.nan_to_num(g[names].to_numpy(float))
        for i, parts in enumerate(g["components"]):
            window = m[max(0, i - 11) : i + 1] if inclusive else m[max(0, i - 12) : i]
            if len(window) < 12:
                assert parts is None and g["loadings"][i] is None
                continue
            cov = np.cov(window.T)
            assert np.allclose([p["variance"] for p in parts], np.sort(np.linalg.eigvalsh(cov))[::-1][:4], atol=1e-8 * max(1.0, np.trace(cov)))
            for p in parts:
                v = np.array([p["loadings"][c] for c in names])
                assert np.abs(v).sum() == pytest.approx(1.0) and v.sum() >= -1e-12
                assert np.allclose(cov @ v, p["variance"] * v, atol=1e-7 * max(1.0, np.trace(cov)))
            assert g["loadings"][i] == parts[0]["loadings"]


def test_refits(spark):
    """One model a period, on the rows before its first row; predictions by the last one; a log that says on what it was trained."""
    rng = np.random.default_rng(6)
    rows = []
    for k, n in enumerate((70, 12, 40)):
        x = rng.normal(size=(n, 2))
        y = 1.5 + x @ np.array([0.5, -2.0]) * (1 + np.arange(n) // 30)
        rows += [(T0 + timedelta(hours=i), f"k{k}", float(y[i]) if i % 9 else None, float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, y double, a double, b double")
    day = F.datediff(TIME, F.lit("2024-01-01"))
    for model in (models.LinearModel(), models.LinearModel(alpha=0.1, l1_ratio=0.5), models.LinearModel(intercept=False, ridge=0.01)):
        log = models.fit_schedule(df, "y", ["a", "b"], 20, day, model)
        found = {(r[KEY], r[TIME]): r for r in log.collect()}
        assert set(found) == {(f"k{k}", T0 + timedelta(days=d)) for k, last in ((0, 2), (2, 1)) for d in range(1, last + 1)}
        for (k, t), r in found.items():
            part = [x for x in rows if x[1] == k and x[0] < t][-20:]
            part = np.array([x[2:] for x in part if x[2] is not None], float)
            assert r.n_train == len(part) and r.last_timestamp_on_train == t - timedelta(hours=1)
            m = part.mean(0) if model.intercept else np.zeros(3)
            c = part - m
            b = nnls_brute(c[:, 1:], c[:, 0], model.alpha * model.l1_ratio, model.alpha * (1 - model.l1_ratio) + model.ridge, nonnegative=False)
            assert [r.coefficients["a"], r.coefficients["b"]] == pytest.approx(b.tolist(), abs=1e-7)
            assert r.intercept == pytest.approx(m[0] - m[1:] @ b, abs=1e-7)
        out = by_key(models.predict(df, log, ["a", "b"]))
        for k, g in out.items():
            for r in g.itertuples():
                last = max((t for kk, t in found if kk == k and t <= r.time_index), default=None)
                if last is None:
                    assert np.isnan(r.predicted) and pd.isna(r.fitted_at)
                else:
                    f = found[k, last]
                    assert r.predicted == pytest.approx(f.intercept + f.coefficients["a"] * r.a + f.coefficients["b"] * r.b)


def test_predictions_of_every_row(spark):
    df = frame(spark, 8, sizes=(60,), missing=0.1, columns=("y", "a"))
    g = by_key(models.rolling_predict(df, "y", ["a"], 15, ridge=0.0))["k0"]
    for i, r in g.iterrows():
        part = g.iloc[max(0, i - 15) : i].dropna(subset=["y", "a"])
        if i < 15 or pd.isna(r["a"]):
            assert pd.isna(r["predicted"])
        else:
            b, c = np.polyfit(part["a"] - 1e6, part["y"], 1)
            assert r["predicted"] == pytest.approx(c + b * (r["a"] - 1e6), rel=1e-6)


def test_dense_fill_by_union(spark):
    df = frame(spark, 3, sizes=(6, 4, 9), missing=0.5).where(F.col(KEY).isNotNull())
    old = fill.ffill(fill.dense(df, df, df), ["x"])
    old = fill.bfill(old.withColumn("x_ahead", F.col("x")), ["x_ahead"]).select(TIME, KEY, "x", "x_ahead")
    new = fill.dense_ffill(df, df, df, ["x"], ["x"])
    assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))


def test_indicators_with_exponential_means(spark):
    df = frame(spark, missing=0).withColumn("close", F.col("x"))
    from tidemark.functions.scalar import feature_name

    ema, macd = {"name": "EMA", "length": 5}, {"name": "MACD", "length": 12}
    for g in by_key(rolling.indicators(df, [ema, macd])).values():
        mean = lambda n: g["close"].ewm(span=n, adjust=False).mean()  # noqa: B023, E731
        assert np.allclose(g[feature_name(ema)], mean(5), equal_nan=True) and np.allclose(g[feature_name(macd)], mean(12) - mean(26), equal_nan=True)


def test_weights_keep_raw_prices_and_hold_with_a_target(spark):
    rng = np.random.default_rng(1)
    rows = [(T0 + timedelta(days=i), k, float(rng.integers(1, 9)) * 100, float(rng.integers(1, 9)), float(rng.integers(0, 3))) for i in range(40) for k in "abcd" if rng.random() < 0.7]
    df = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, market_cap double, price double, volume double")
    out = signals.market_cap_weights(df, 2, (3, 5), 0.0, 0.0, keep=True).toPandas()
    raw = {(t.to_pydatetime(), k): (p, v) for t, k, p, v in out[[TIME, KEY, "price", "volume"]].itertuples(index=False) if not pd.isna(p)}
    assert raw == {(t, k): (p, v) for t, k, _, p, v in rows}
    assert len(out) == out[TIME].nunique() * 4 and np.allclose(out.groupby(TIME)["signal_weight"].sum(), 1.0)
    scaled = signals.market_cap_weights(df, 2, (3, 5), 0.0, 0.0, target_volatility=0.05).toPandas().groupby(TIME)["signal_weight"].sum()
    assert scaled.max() <= 1 + 1e-12 and scaled.min() < 0.9
