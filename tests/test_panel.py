"""Edge cases of the panel operators, by hand or against pandas."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import bars, calendars, fill, merge, models, portfolio, ranges, reshape, rolling, signals
from tidemark.operators import watermarks as wm

T0 = datetime(2024, 1, 1)
H = timedelta(hours=1)


def panel(spark, rows, value="double"):
    return spark.createDataFrame([(T0 + t * H, k, v) for t, k, v in rows], f"time_index timestamp, unique_identifier string, v {value}")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_normalize(spark):
    df = spark.createDataFrame([(T0, None, float("nan")), (T0, "a", float("inf")), (T0, "b", 1.0)], "time_index timestamp, unique_identifier string, v double")
    assert sorted((r.unique_identifier, r.v) for r in schema.normalize(df).collect()) == [("", None), ("a", None), ("b", 1.0)] or {r.unique_identifier: r.v for r in schema.normalize(df).collect()} == {"": None, "a": None, "b": 1.0}


def test_validate(spark):
    bad = spark.createDataFrame([(T0, "a", 1.0)], "time_index timestamp, unique_identifier string, V double")
    with pytest.raises(ValueError):
        schema.validate_update(bad)
    with pytest.raises(TypeError):
        schema.validate_update(bad.withColumn("time_index", F.lit("x")))
    twice = panel(spark, [(0, "a", 1.0), (0, "a", 2.0)])
    with pytest.raises(ValueError):
        schema.reject_duplicates(twice)


@pytest.mark.parametrize("x", [1704067200, 1704067200000, 1704067200000000, 1704067200000000000])
def test_epochs(spark, x):
    df = spark.createDataFrame([(x,)], "x long")
    assert df.select(schema.coerce_timestamp(F.col("x"), df.schema["x"].dataType).alias("t")).first().t == T0


def test_range_map(spark):
    df = panel(spark, [(t, k, float(t)) for t in range(4) for k in "abc"])
    made = ranges.range_table(spark, {"a": ranges.Range(T0 + H, T0 + 2 * H), "b": ranges.Range(T0 + H, start_operand=">"), "x": ranges.Range()})
    assert got(ranges.range_read(df, ranges=made), "unique_identifier", "v") == [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)]
    assert ranges.range_read(df, ranges=ranges.range_table(spark, {})).count() == 0
    assert got(ranges.range_read(df, start=T0 + 3 * H, ranges=made, combine="and"), "unique_identifier", "v") == [("b", 3.0)]
    with pytest.raises(ValueError):
        ranges.range_read(df, columns=["none"])
    assert ranges.range_read(df, columns=["none"], on_missing="empty").count() == 0


def test_upsert(spark):
    old = panel(spark, [(0, "a", 1.0), (1, "a", 2.0)])
    new = panel(spark, [(1, "a", None), (2, "a", 3.0)]).withColumn("w", F.lit(7))
    out = {r.time_index: (r.v, r.w) for r in merge.upsert(old, new).collect()}
    assert out == {T0: (1.0, None), T0 + H: (2.0, 7), T0 + 2 * H: (3.0, 7)}
    assert {r.time_index: r.v for r in merge.upsert(old, new, mode="replace").collect()} == {T0: 1.0, T0 + H: None, T0 + 2 * H: 3.0}
    assert got(merge.upsert(old, new.limit(0)), "v") == [(1.0,), (2.0,)]


def test_newer(spark):
    df = panel(spark, [(0, "a", 1.0), (1, "a", 2.0), (0, "b", 3.0)])
    stats = wm.watermarks(df.where("time_index < '2024-01-01 00:30:00' AND unique_identifier = 'a'"))
    assert got(wm.newer(df, stats), "unique_identifier", "v") == [("a", 2.0), ("b", 3.0)]
    top = wm.watermarks(df, [])
    assert wm.newer(df, top, []).count() == 1


def test_asof(spark):
    data = panel(spark, [(1, "a", 1.0), (3, "a", None), (4, "a", 2.0)])
    grid = panel(spark, [(t, "a", 0.0) for t in range(6)]).select("time_index", "unique_identifier")
    assert [r.v for r in fill.asof(grid, data, ["v"]).orderBy("time_index").collect()] == [None, 1.0, 1.0, 1.0, 2.0, 2.0]
    bound = fill.asof(grid, data, ["v"], tolerance="1 HOUR").orderBy("time_index")
    assert [r.v for r in bound.collect()] == [None, 1.0, None, 1.0, 2.0, None]
    assert "CartesianProduct" not in bound._jdf.queryExecution().toString()


def test_fill_and_returns(spark):
    df = panel(spark, [(0, "a", None), (1, "a", 1.0), (2, "a", None), (3, "a", 2.0)])
    assert [r.v for r in fill.bfill(fill.ffill(df, ["v"]), ["v"]).orderBy("time_index").collect()] == [1.0, 1.0, 1.0, 2.0]
    out = df.select("time_index", rolling.padded_return(F.col("v")).alias("r"), rolling.simple_return(F.col("v")).alias("s")).orderBy("time_index").collect()
    assert [r.r for r in out] == [None, None, 0.0, 1.0]
    assert [r.s for r in out] == [0.0] * 4


def test_average_rank_and_ewm(spark):
    x = [3.0, 1.0, 3.0, None, 2.0]
    df = spark.createDataFrame([(T0, str(i), v) for i, v in enumerate(x)], "time_index timestamp, unique_identifier string, v double")
    out = {r.unique_identifier: r.rk for r in df.select("unique_identifier", rolling.average_rank(F.col("v")).alias("rk")).collect()}
    want = pd.Series(x).rank(ascending=False)
    assert all((out[str(i)] is None and np.isnan(w)) or out[str(i)] == w for i, w in enumerate(want))
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    df = panel(spark, [(i, "a", float(a)) for i, a in enumerate(v)])
    mine = [r.s for r in df.select("time_index", rolling.ewm_std(F.col("v"), 10).alias("s")).orderBy("time_index").collect()]
    theirs = pd.Series(v).ewm(span=10, adjust=False).std().to_numpy()
    assert mine[0] is None and np.allclose(np.array(mine[1:], float), theirs[1:], atol=1e-9)
    ema = [r.s for r in df.select("time_index", rolling.ema(F.col("v"), 10).alias("s")).orderBy("time_index").collect()]
    assert np.allclose(ema, pd.Series(v).ewm(span=10, adjust=False).mean(), atol=1e-9)


def test_rolling_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ np.array([0.3, 0.7])
    rows = [(T0 + i * H, "a", float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "time_index timestamp, unique_identifier string, y double, f1 double, f2 double")
    last = models.rolling_regression(df, "y", ["f1", "f2"], 30).orderBy(F.desc("time_index")).first()
    assert last.weights["f1"] == pytest.approx(0.3, abs=1e-6) and last.weights["f2"] == pytest.approx(0.7, abs=1e-6)
    assert models.rolling_regression(df, "y", ["f1", "f2"], 30).where("weights IS NULL").count() == 29
    shrunk = models.rolling_regression(df, "y", ["f1", "f2"], 30, alpha=10.0).orderBy(F.desc("time_index")).first()
    assert shrunk.weights == {"f1": 0.0, "f2": 0.0}
    pred = models.rolling_predict(df, "y", ["f1", "f2"], 30).orderBy(F.desc("time_index")).first()
    assert pred.predicted == pytest.approx(y[-1], abs=1e-5)
    load = models.rolling_pca(df, ["f1", "f2"], 30).orderBy(F.desc("time_index")).first().loadings
    assert sum(abs(v) for v in load.values()) == pytest.approx(1)


def test_calendar(spark):
    s = calendars.sessions(spark, date(2024, 1, 1), date(2024, 12, 31), "XNYS")
    days = {r.session: r for r in s.collect()}
    assert len(days) == 252
    for closed in (date(2024, 1, 1), date(2024, 3, 29), date(2024, 6, 19), date(2024, 7, 4), date(2024, 11, 28), date(2024, 12, 25), date(2024, 1, 6)):
        assert closed not in days
    assert days[date(2024, 1, 2)].market_open == datetime(2024, 1, 2, 14, 30)
    assert days[date(2024, 7, 2)].market_open == datetime(2024, 7, 2, 13, 30)
    assert days[date(2024, 7, 3)].market_close == datetime(2024, 7, 3, 17, 0)
    assert days[date(2024, 11, 29)].market_close == datetime(2024, 11, 29, 18, 0)
    assert calendars.sessions(spark, date(2024, 1, 1), date(2024, 1, 7)).count() == 7


def bar(t, k, o, h, l, c, v):
    return (t, k, o, h, l, c, v)


BAR = "time_index timestamp, unique_identifier string, open double, high double, low double, close double, volume double"


def test_fill_daily_seed(spark):
    schedule = calendars.sessions(spark, date(2024, 1, 1), date(2024, 1, 6))
    at = lambda d: datetime(2024, 1, d, 23, 59)
    b = spark.createDataFrame([bar(at(3), "a", 1.0, 2.0, 0.5, 1.5, 10.0), bar(at(5), "a", 2.0, 2.0, 2.0, 2.0, 5.0)], BAR)
    out = bars.fill_daily(b, schedule).orderBy("time_index").collect()
    assert [(r.time_index.day, r.open, r.close, r.volume, r.interpolated) for r in out] == [(3, 1.0, 1.5, 10.0, False), (4, 1.5, 1.5, 0.0, True), (5, 2.0, 2.0, 5.0, False)]


def test_fill_intraday(spark):
    schedule = calendars.sessions(spark, date(2024, 1, 2), date(2024, 1, 3), "XNYS")
    t = datetime(2024, 1, 2, 14, 30)
    b = spark.createDataFrame([bar(t, "a", 1.0, 1.0, 1.0, 1.0, 1.0), bar(t + timedelta(minutes=30), "a", 2.0, 2.0, 2.0, 2.0, 1.0), bar(datetime(2024, 1, 3, 14, 45), "a", 3.0, 3.0, 3.0, 3.0, 1.0)], BAR)
    out = bars.fill_intraday(b, schedule, "15m").orderBy("time_index").collect()
    first = [r for r in out if r.time_index.day == 2]
    assert len(first) == 27 and first[1].close == 1.0 and first[1].interpolated and first[1].volume == 0.0 and first[2].close == 2.0 and not first[2].interpolated
    assert [r.close for r in out if r.time_index.day == 3] == [2.0, 3.0]


def test_upsample(spark):
    b = spark.createDataFrame([bar(T0 + i * H, "a", float(i), i + 1.0, i - 1.0, i + 0.5, 1.0) for i in range(5)], BAR)
    out = bars.upsample(b, "1h", "3h").orderBy("time_index").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in out] == [(0.0, 3.0, -1.0, 2.5, 3.0), (1.0, 4.0, 0.0, 3.5, 3.0), (2.0, 5.0, 1.0, 4.5, 3.0)]
    assert bars.upsample(b, "1h", "1h").count() == 5


def test_weights_on_grid(spark):
    w = panel(spark, [(0, "a", 0.5), (0, "b", 0.5), (2, "a", 1.0)]).withColumnRenamed("v", "signal_weight")
    grid = panel(spark, [(t, "x", 0.0) for t in range(6)]).select("time_index")
    out = got(signals.weights_on_grid(w, grid, "3 HOURS"), "time_index", "unique_identifier", "signal_weight")
    assert out == [(T0, "a", 0.5), (T0, "b", 0.5), (T0 + H, "a", 0.5), (T0 + H, "b", 0.5)] + [x for t in (2, 3, 4) for x in ((T0 + t * H, "a", 1.0), (T0 + t * H, "b", 0.0))]


def test_rebalance(spark):
    f = spark.createDataFrame([(T0 + t * H, "a", w, 10.0, 1.0) for t, w in enumerate([0.5, 1.0])], "time_index timestamp, unique_identifier string, weights double, price double, volume double")
    assert got(portfolio.immediate(f), "weights_before", "weights_current") == [(0.0, 0.5), (0.5, 1.0)]
    seed = spark.createDataFrame([(T0 - H, "a", 0.25, 9.0, 1.0)], f.schema)
    assert got(portfolio.immediate(f, seed), "weights_before", "weights_current") == [(0.25, 0.5), (0.5, 1.0)]
    slow = portfolio.volume_participation(f.withColumn("portfolio", F.lit("p")).withColumn("volume", F.lit(10.0)), 1000.0, 1.0)
    assert [r.weights for r in slow.orderBy("time_index").collect()] == pytest.approx([0.1, 0.2])
    ramp = portfolio.time_weighted(panel(spark, [(t, "a", 0.0) for t in range(4)]), panel(spark, [(0, "a", 1.0)]).withColumnRenamed("v", "weights"), "2h")
    assert [r.weights for r in ramp.orderBy("time_index").collect()] == pytest.approx([0.0, 0.5, 1.0, 1.0])


def test_portfolio(spark):
    prices = panel(spark, [(0, "a", 10.0), (1, "a", 11.0), (2, "a", 11.0)]).withColumnRenamed("v", "close")
    f = prices.select("time_index", "unique_identifier", F.lit(1.0).alias("weights"), F.col("close").alias("price"), F.lit(1.0).alias("volume"))
    r = portfolio.portfolio_returns(portfolio.immediate(f), prices, 0.01)
    v = portfolio.portfolio_values(r).orderBy("time_index").collect()
    assert [x["return"] for x in v] == pytest.approx([-0.01, 0.1, 0.0]) and v[-1].close == pytest.approx(0.99 * 1.1)
    wide = portfolio.serialized(portfolio.portfolio_values(r), portfolio.immediate(f))
    back = portfolio.last_weights(wide).collect()
    assert [(b.unique_identifier, b.weights, b.price) for b in back] == [("a", 1.0, 11.0)]
    other = portfolio.override_close(portfolio.portfolio_values(r), prices, "a").orderBy("time_index").collect()
    assert [o.close for o in other] == [10.0, 11.0, 11.0] and [o["return"] for o in other] == pytest.approx([0.0, 0.1, 0.0])


def test_account_signed(spark):
    held = spark.createDataFrame([("x", 10.0, 5.0, 1)], "asset_id string, quantity double, price double, order_time int")
    want = spark.createDataFrame([("x", 0.0)], "asset_id string, quantity double")
    assert portfolio.account_rebalance(held, want, 100.0, 0.1).first().trade == -10.0
    assert portfolio.account_rebalance(held, want, 100.0, 0.1, signed=True).first().trade == 0.0


def test_names_and_maps(spark):
    from tidemark.functions import scalar

    c = {"name": "SMA", "length": 5}
    assert scalar.feature_config(scalar.feature_name(c)) == c
    assert scalar.interval("1q") == "3 MONTH" and scalar.minutes("1d") == 1440
    with pytest.raises(ValueError):
        scalar.minutes("1mo")
    cell = spark.createDataFrame([({1: 0.5, 30: 0.6},), (None,)], "m map<int,double>").select(scalar.curve_nodes(scalar.curve_cell("m")).alias("m"))
    assert [r.m for r in cell.collect()] == [{1: 0.5, 30: 0.6}, None]
    m = reshape.to_map(panel(spark, [(0, "b", 1.0), (0, "a", None), (0, "c", 2.0)]), "v", as_json=True).first().v
    assert m == '{"b":1.0,"c":2.0}'
    ind = rolling.indicators(panel(spark, [(i, "a", float(i)) for i in range(6)]).withColumnRenamed("v", "close"), [c, {"name": "RSI", "length": 3}])
    assert ind.orderBy(F.desc("time_index")).first()[scalar.feature_name({"name": "RSI", "length": 3})] == 100.0


def test_replication(spark):
    rng = np.random.default_rng(2)
    a, b = np.cumprod(1 + rng.normal(0, 0.01, 80)), np.cumprod(1 + rng.normal(0, 0.01, 80))
    r = 0.25 * (a[1:] / a[:-1] - 1) + 0.75 * (b[1:] / b[:-1] - 1)
    t = np.append(1.0, np.cumprod(1 + r))
    rows = [(i, k, float(v[i])) for i in range(80) for k, v in (("a", a), ("b", b), ("t", t))]
    w = signals.replication_weights(panel(spark, rows).withColumnRenamed("v", "close"), "t", ["a", "b"], 40)
    last = {x.unique_identifier: x.signal_weight for x in w.where(F.col("time_index") == T0 + 79 * H).collect()}
    assert last == pytest.approx({"a": 0.25, "b": 0.75}, abs=1e-4)


def test_rolling_ols(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    y = 2 + 3 * x + rng.normal(0, 0.1, 40)
    rows = [(T0 + i * H, "a", None if i == 5 else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    out = rolling.rolling_ols(spark.createDataFrame(rows, "time_index timestamp, unique_identifier string, x double, y double"), "y", "x", 20).orderBy("time_index").collect()
    assert all(r.beta is None for r in out[:25]) and out[25].beta is not None
    a = np.column_stack([np.ones(20), x[20:]])
    b, *_ = np.linalg.lstsq(a, y[20:], rcond=None)
    s2 = ((y[20:] - a @ b) ** 2).sum() / 19
    t = b / np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))
    last = out[-1]
    assert (last.intercept, last.beta) == pytest.approx(tuple(b)) and (last.t_intercept, last.t_beta) == pytest.approx(tuple(t))
    assert last.r_squared == pytest.approx(np.corrcoef(x[20:], y[20:])[0, 1] ** 2)
