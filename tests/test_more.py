"""Stores, databases, bars, nodes and instruments: cases that the queries over the driver tables don't reach."""

import math
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import normal_cdf
from tidemark.instruments import curves, pricing
from tidemark.operators import bars, merge, portfolio, ranges, rolling
from tidemark.plans.node import FunctionNode, run
from tidemark.schema import KEY, TIME
from tidemark.sources import store as stores
from tidemark.sources.store import PanelStore

T0 = datetime(2024, 1, 31, 20, tzinfo=timezone.utc)


def panel(spark, rows, columns="x double"):
    return spark.createDataFrame(rows, f"{TIME} timestamp, {KEY} string, {columns}")


@pytest.mark.parametrize("hours", [5, -9, 0])
def test_bounds_with_an_offset(spark, tmp_path, hours):
    store = PanelStore(spark, f"file://{tmp_path}")
    times = [T0 + timedelta(hours=6 * i) for i in range(12)]
    for partition in ("day", "month"):
        store.upsert(panel(spark, [(t, "a", float(i)) for i, t in enumerate(times)]), f"p_{partition}", partition=partition)
        zone = timezone(timedelta(hours=hours))
        for lo in times:
            start = lo.astimezone(zone)
            end = (lo + timedelta(hours=13)).astimezone(zone)
            want = sorted(float(i) for i, t in enumerate(times) if start <= t <= end)
            assert sorted(r.x for r in store.read(f"p_{partition}", start, end).collect()) == want
        assert store.capped(f"p_{partition}", 1, start=times[-1].astimezone(zone)).count() == 1


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Pacific/Kiritimati"])
def test_partitions_are_in_utc_whatever_the_session(spark, tmp_path, zone):
    times = [T0 + timedelta(hours=5 * i) for i in range(20)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        store = PanelStore(spark, f"file://{tmp_path}")
        for partition in ("day", "month"):
            store.upsert(panel(spark, [(t, "a", float(i)) for i, t in enumerate(times)]), f"p_{partition}", partition=partition)
            for lo in times:
                end = lo + timedelta(hours=26)
                assert sorted(r.x for r in store.read(f"p_{partition}", lo, end).collect()) == [float(i) for i, t in enumerate(times) if lo <= t <= end]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_second_writer_fails(spark, tmp_path):
    store = PanelStore(spark, f"file://{tmp_path}")
    store.upsert(panel(spark, [(T0, "a", 1.0)]), "p")
    seen = store.describe("p")
    store.upsert(panel(spark, [(T0, "b", 2.0)]), "p")
    with pytest.raises(RuntimeError, match="another writer"):
        store._write(seen, panel(spark, [(T0, "c", 3.0)]), ["202401"], keep=True)
    assert sorted(r[KEY] for r in store.scan("p").collect()) == ["a", "b"]
    for i in range(6):
        store.upsert(panel(spark, [(T0, "b", float(i))]), "p")
    assert len(store._pointers("p")) == 1 + stores.KEPT_POINTERS and {r.x for r in store.scan("p").collect()} == {1.0, 5.0}


def test_compaction_keeps_the_newest_row(spark, tmp_path):
    import time

    store = PanelStore(spark, f"file://{tmp_path}")
    store.upsert(panel(spark, [(T0, "a", 1.0)]), "p")
    t = store.describe("p")
    time.sleep(1.1)
    store._write(t, panel(spark, [(T0, "a", 0.5)]), ["202401"], keep=True)
    assert store.scan("p").count() == 2
    store.compact("p")
    assert [r.x for r in store.scan("p").collect()] == [0.5]


def test_metadata_and_assets_of_nodes(spark, tmp_path):
    class Prices(FunctionNode):
        def asset_list(self, context):
            return spark.createDataFrame([("a",), ("b",)], f"{KEY} string")

        def column_metadata(self):
            return {"x": {"label": "price"}}

        def table_metadata(self):
            return {"source": "test"}

    store = PanelStore(spark, f"file://{tmp_path}")
    node = Prices("prices", lambda c: panel(spark, [(T0, k, 1.0) for k in "abc"]))
    run(store, node)
    assert sorted(r[KEY] for r in store.scan(node.storage_name).collect()) == ["a", "b"]
    assert '"label": "price"' in store.describe(node.storage_name).meta and '"source": "test"' in store.describe(node.storage_name).meta
    with pytest.raises(ValueError, match="no such columns"):
        store.annotate(node.storage_name, {"y": {}})


# -- databases (Derby comes with Spark)


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(datetime(2024, 1, d, tzinfo=timezone.utc), k, float(d)) for d in range(1, 11) for k in "abc"]
    stores.execute(spark, url, [f'CREATE TABLE p ("{TIME}" TIMESTAMP, "{KEY}" VARCHAR(20), "x" DOUBLE)'])
    stores.write_database(panel(spark, rows), url, "p")
    read = lambda **o: sorted((r[KEY], r.x) for r in stores.read_database(spark, url, "p", [TIME, KEY, "x"], **o).collect())
    assert len(read()) == 30
    assert read(ids=["a", "q'x"]) == [("a", float(d)) for d in range(1, 11)] and read(ids=[]) == []
    assert read(bounds=[("2024-01-03 00:00:00", "2024-01-05 00:00:00"), ("2024-01-09 00:00:00", None)], ids=["b"]) == [("b", x) for x in (3.0, 4.0, 9.0, 10.0)]
    by_id = {"a": ranges.Range(datetime(2024, 1, 9), None, ">", "<="), "c": ranges.Range(None, datetime(2024, 1, 2))}
    assert read(ranges=by_id) == [("a", 10.0), ("c", 1.0), ("c", 2.0)]
    # what lies in the new rows' span goes, by identifier
    new = [(datetime(2024, 1, 2, tzinfo=timezone.utc), "a", -1.0), (datetime(2024, 1, 9, tzinfo=timezone.utc), "a", -2.0), (datetime(2024, 1, 4, tzinfo=timezone.utc), "b", -3.0)]
    stores.replace_in_database(panel(spark, new), url, "p")
    got = read()
    assert [x for k, x in got if k == "a"] == [-2.0, -1.0, 1.0, 10.0] and len([1 for k, _ in got if k == "b"]) == 10 and ("b", -3.0) in got and ("b", 4.0) not in got
    assert len([1 for k, _ in got if k == "c"]) == 10


# -- bars


SCHEDULE = "session date, market_open timestamp, market_close timestamp"


def test_partly_empty_bars_keep_their_volume(spark):
    day = [(date(2024, 1, d), datetime(2024, 1, d, tzinfo=timezone.utc), datetime(2024, 1, d, 23, 59, tzinfo=timezone.utc)) for d in (2, 3)]
    s = spark.createDataFrame(day, SCHEDULE)
    b = panel(spark, [(day[0][2], "a", 1.0, 2.5, 0.5, 2.0, 100.0, 7, 1.5), (day[1][2], "a", 2.0, 3.5, 1.5, 3.0, 50.0, 4, None)], "open double, high double, low double, close double, volume double, trade_count long, vwap double")
    out = {r[TIME]: r for r in bars.fill_daily(b, s).collect()}
    last = out[max(out)]
    assert (last.volume, last.trade_count, last.interpolated, last.open, last.vwap) == (50.0, 4, True, 3.0, 1.5)
    # within a day only the close counts
    out = {r[TIME]: r for r in bars.fill_intraday(b, s, "1m").where(F.col("volume") > 0).collect()}
    assert [(r.volume, r.open, r.interpolated) for _, r in sorted(out.items())] == [(100.0, 1.0, False), (50.0, 2.0, False)]


def test_sessions_across_midnight(spark):
    s = spark.createDataFrame([(date(2024, 1, 2), datetime(2024, 1, 1, 22, tzinfo=timezone.utc), datetime(2024, 1, 2, 4, tzinfo=timezone.utc))], SCHEDULE)
    b = panel(spark, [(datetime(2024, 1, 1, 21, tzinfo=timezone.utc), "a", 1.0), (datetime(2024, 1, 1, 23, tzinfo=timezone.utc), "a", 2.0), (datetime(2024, 1, 2, 3, tzinfo=timezone.utc), "a", 3.0)])
    joined = bars.in_sessions(b, s)
    assert sorted(r.x for r in joined.collect()) == [2.0, 3.0]
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString() and "NestedLoop" not in joined._jdf.queryExecution().toString()


# -- instruments


def test_normal_distribution(spark):
    x = [-40.0, -9.0, -7.2, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.9, 7.3, 38.0]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "v double").select(normal_cdf(F.col("v")).alias("y")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rel=1e-9, abs=1e-14)
    assert spark.range(1).select(normal_cdf(F.lit(None).cast("double")).alias("y")).first().y is None


def test_swap_legs(spark):
    swaps = spark.createDataFrame([("s", 1e6, 0.05, date(2024, 1, 2), date(2024, 7, 2), 3, "c")], "ins_id string, notional double, fixed_rate double, start_date date, end_date date, months int, curve_id string")
    nodes = spark.createDataFrame([("c", 360, 0.05)], "curve_id string, days int, zero double")
    at = F.lit(date(2024, 2, 1))
    fixings = spark.createDataFrame([("c", date(2024, 1, 2), 0.04), ("c", date(2024, 1, 12), 0.06), ("c", date(2023, 12, 29), 0.9)], "curve_id string, fixing_date date, rate double")
    flow = lambda df: {(r.leg, r.payment_date): r.amount for r in df.collect()}
    end = date(2024, 4, 2)
    term = flow(pricing.swap_cashflows(swaps, nodes, at, fixings=fixings))
    assert term["floating", end] == pytest.approx(1e6 * 0.04 * 91 / 360)
    assert flow(pricing.swap_cashflows(swaps, nodes, at))["floating", end] != term["floating", end]
    df = lambda n: math.exp(math.log(1 / 1.05) * n / 360)
    overnight = flow(pricing.overnight_cashflows(swaps, nodes, at, fixings))
    grown = (1 + 0.04 * 10 / 360) * (1 + 0.06 * 20 / 360)
    assert overnight["floating", end] == pytest.approx(1e6 * (grown / df(61) - 1))
    assert overnight["floating", date(2024, 7, 2)] == pytest.approx(1e6 * (df(61) / df(152) - 1))
    assert overnight["fixed", end] == term["fixed", end] == pytest.approx(-1e6 * 0.05 * 91 / 360)
    spot = pricing.spot_start(swaps.withColumn("start_date", F.lit(None).cast("date")), F.lit(date(2024, 1, 4))).first().start_date
    assert spot == date(2024, 1, 8)


def test_yields_of_a_batch(spark):
    rows = [(100.0, [1.0, 2.0], [5.0, 105.0]), (90.0, [0.5], [100.0]), (None, [1.0], [1.0]), (50.0, [], []), (-5.0, [1.0], [100.0])]
    got = [r.y for r in spark.createDataFrame(rows, "p double, t array<double>, a array<double>").select(pricing.solve_yield("p", "t", "a").alias("y")).collect()]
    assert got[0] == pytest.approx(math.log(1.05), abs=1e-9) and got[1] == pytest.approx(math.log(100 / 90) / 0.5, abs=1e-9)
    assert got[2] is None and got[3] is None and got[4] is None


def test_more_indicators(spark):
    x = [3.0, 5.0, 4.0, 8.0, 6.0]
    df = panel(spark, [(T0 + timedelta(days=i), "a", v) for i, v in enumerate(x)])
    c = F.col("x")
    last = df.select(TIME, rolling.wma(c, 3).alias("wma"), rolling.momentum(c, 2).alias("mom"), rolling.rate_of_change(c, 2).alias("roc"), rolling.stochastic(c, 4).alias("k"), rolling.percent_b(c, 4).alias("b"), rolling.z_score(c, 4).alias("z"), rolling.macd(c, 2).alias("macd")).orderBy(F.desc(TIME)).first()
    assert last.wma == pytest.approx((4 + 16 + 18) / 6) and last.mom == 2.0 and last.roc == pytest.approx(50.0) and last.k == pytest.approx(50.0)
    mean, var = 5.75, sum((v - 5.75) ** 2 for v in x[1:])
    assert last.b == pytest.approx((6 - mean) / (4 * math.sqrt(var / 4)) + 0.5) and last.z == pytest.approx((6 - mean) / math.sqrt(var / 3))

    def ema(n):
        y, a = x[0], 2 / (n + 1)
        for v in x[1:]:
            y = a * v + (1 - a) * y
        return y

    assert last.macd == pytest.approx(ema(2) - ema(4))


def test_required_values(spark):
    df = panel(spark, [(T0, "a", 1.0), (T0, "b", None)])
    with pytest.raises(ValueError, match=r"x \(1 of 2\)"):
        ranges.require_values(df, ["x"])
    assert ranges.require_values(df, [KEY]).count() == 2


def test_london_days():
    from tidemark.operators.calendars import xlon_early, xlon_holidays

    known = {2022: "01-03 04-15 04-18 05-02 06-02 06-03 08-29 09-19 12-26 12-27", 2021: "01-01 04-02 04-05 05-03 05-31 08-30 12-27 12-28", 2020: "01-01 04-10 04-13 05-08 05-25 08-31 12-25 12-28", 1999: "01-01 04-02 04-05 05-03 05-31 08-30 12-27 12-28 12-31"}
    for year, days in known.items():
        assert xlon_holidays(year) == {date.fromisoformat(f"{year}-{d}") for d in days.split()}
    assert xlon_early(2021) == {date(2021, 12, 24), date(2021, 12, 31)} and xlon_early(2023) == {date(2023, 12, 22), date(2023, 12, 29)}


def test_business_days(spark):
    from tidemark.operators import calendars as c

    days = c.open_days(spark, date(2023, 12, 1), date(2024, 2, 28), "XNYS")
    df = spark.createDataFrame([(date(2023, 12, 30), date(2024, 1, 16)), (date(2023, 12, 29), date(2024, 1, 2)), (date(2024, 1, 13), date(2024, 1, 13)), (date(2025, 1, 1), None)], "a date, b date")
    out = c.counted(c.moved(c.rolled(c.rolled(c.rolled(df, days, "a", "m"), days, "a", "f", "FOLLOWING"), days, "a", "p", "PRECEDING"), days, "a", 2, "spot"), days, "a", "b", "n")
    got = [tuple(r)[2:] for r in out.orderBy("a").collect()]
    d = lambda m, x, y=2024: date(y, m, x)
    assert got == [(d(12, 29, 2023), d(12, 29, 2023), d(12, 29, 2023), d(1, 3), 1), (d(12, 29, 2023), d(1, 2), d(12, 29, 2023), d(1, 4), 10), (d(1, 16), d(1, 16), d(1, 12), d(1, 18), 0), (None,) * 5]


def test_growth_by_running_products(spark):
    """Against a plain loop over fixings, with spans before, between and after them and repeated spans."""
    import random

    rng = random.Random(1)
    fixed = {c: sorted({date(2024, 1, 1) + timedelta(days=rng.randrange(200)) for _ in range(40)}) for c in "ab"}
    rates = {(c, d): rng.random() / 5 for c in fixed for d in fixed[c]}
    spans = [(c, s := date(2023, 12, 20) + timedelta(days=rng.randrange(230)), s + timedelta(days=rng.randrange(1, 60))) for c in "abz" for _ in range(60)]
    fixings = spark.createDataFrame([(c, d, r) for (c, d), r in rates.items()], "curve_id string, fixing_date date, rate double")
    out = pricing.growth(spark.createDataFrame(spans, "curve_id string, period_start date, period_end date"), fixings).collect()
    assert len(out) == len(spans)
    for c, s, e, grown in out:
        want, at = 1.0, fixed.get(c, [])
        for d, after in zip(at, [*at[1:], date(2100, 1, 1)], strict=False):
            want *= 1 + rates[c, d] * max(0, (min(after, e) - max(d, s)).days) / 360 if d < e and after > s else 1.0
        assert grown == pytest.approx(want, rel=1e-12)


def test_maps_are_not_filled_in_one_task(spark):
    """Maps of a rebalance reach the portfolio's later rows by its time: no window holds maps, and the last row alone is parsed for its weights."""
    at = lambda d: datetime(2024, 1, d)
    moved = portfolio.immediate(spark.createDataFrame([(at(2), "a", 0.5, 1.0, None), (at(2), "b", 0.5, 2.0, 7.0), (at(4), "a", 1.0, None, 3.0), (at(4), "b", None, 2.5, 7.0)], "time_index timestamp, unique_identifier string, weights double, price double, volume double"))
    rows = spark.createDataFrame([(at(d), float(d)) for d in (1, 2, 3, 4, 5)], "time_index timestamp, close double")
    wide = portfolio.serialized(rows, moved)
    out = {r.time_index.day: (r.close, r.rebalance_weights, r.weights_at_last_rebalance, r.last_rebalance_date) for r in wide.collect()}
    first, second = ('{"a":0.5,"b":0.5}', '{"a":0.0,"b":0.0}', "2024-01-02 00:00:00"), ('{"a":1.0}', '{"a":0.5,"b":0.5}', "2024-01-04 00:00:00")
    assert out == {2: (2.0, *first), 3: (3.0, *first), 4: (4.0, *second), 5: (5.0, *second)}
    windows = [x for x in wide._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and not any("rebalance_" in x and "map" in x or "rebalance_weights" in x for x in windows)
    back = portfolio.last_weights(wide)
    assert sorted((r.unique_identifier, r.weights, r.price, r.volume) for r in back.collect()) == [("a", 1.0, None, 3.0), ("b", None, 2.5, 7.0)]
    assert "TakeOrdered" not in back._jdf.queryExecution().executedPlan().toString() and portfolio.last_weights(wide.limit(0)).count() == 0


def test_rows_of_one_curve_are_dealt_to_many_tasks(spark):
    """A curve that all rows share doesn't bring them into one task; rows of unknown curves stay."""
    nodes = spark.createDataFrame([("c", 360, 0.05), ("d", 360, 0.02)], "curve_id string, days int, zero double")
    rows = spark.range(400).selectExpr("id", "CASE WHEN id = 7 THEN NULL WHEN id = 8 THEN 'x' ELSE 'c' END AS curve_id", "CAST(id AS int) AS days")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        out = curves.discounted(rows, nodes).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(r.id for r in out) == list(range(400)) and {r.id for r in out if r.df is None} == {7, 8}
    assert len({r.task for r in out}) > 1 and all(abs(r.df - (1 / (1.05)) ** (r.id / 360)) < 1e-2 for r in out if r.df is not None)


# -- tasks by the number of rows


def test_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """A task's rows don't grow with the table, and neither the last row of a key nor an alignment deals them again."""
    monkeypatch.setattr(merge, "TASK_ROWS", 100)
    rows = [(T0 + timedelta(hours=i % 50), f"k{i % 7}", float(i)) for i in range(3000)]
    p = merge.dealt(panel(spark, rows), len(rows))
    assert p.rdd.getNumPartitions() == 30 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert merge.dealt(p, 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    even, odd = (merge.keep_one(p.where(F.col("x") % 2 == k), ["x"]) for k in (0, 1))
    both = merge.align({"even": even, "odd": odd}, "x", fill=0.0)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2
    want: dict = {}
    for t, k, x in rows:
        want.setdefault((t, k), [0.0, 0.0])[int(x) % 2] = x
    assert {(r[TIME].replace(tzinfo=timezone.utc), r[KEY]): [r.even, r.odd] for r in both.collect()} == want


def test_rewrites_make_few_files(spark, tmp_path, monkeypatch):
    """A file a partition, or one for FILE_ROWS rows; a batch of new keys is written once; what fails leaves nothing; repeats go with a dropped column."""
    import time

    store = PanelStore(spark, f"file://{tmp_path}")
    files = lambda: [len(list(tmp_path.glob(f"{path.split(str(tmp_path))[1][1:]}/*.parquet"))) for _, path in store.describe("p").parts]
    folders = lambda: len(list(tmp_path.glob("p/v=*"))) + len(list(tmp_path.glob("p/_batch*")))
    rows = [(T0 + timedelta(hours=i), f"k{k}", float(i), k) for i in range(60) for k in range(40)]
    store.upsert(panel(spark, rows, "x double, y int").repartition(4), "p")
    assert files() == [1, 1] and folders() == 1
    with pytest.raises(ValueError, match="repeated key"):
        store.upsert(panel(spark, [rows[0], rows[0]], "x double, y int"), "p")
    assert folders() == 1
    time.sleep(1.1)
    store._write(store.describe("p"), panel(spark, [(T0, "k0", -5.0, 0)], "x double, y int"), ["202401"], keep=True)
    store.drop_columns("p", ["y"])
    monkeypatch.setattr(stores, "FILE_ROWS", 500)
    assert files() == [1, 1]
    store.compact("p")
    assert all(1 < n <= 5 for n in files())
    want = sorted((t, k, -5.0 if (t, k) == (T0, "k0") else x) for t, k, x, _ in rows)
    assert sorted((r[TIME].replace(tzinfo=timezone.utc), r[KEY], r.x) for r in store.scan("p").collect()) == want
