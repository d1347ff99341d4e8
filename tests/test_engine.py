"""Store, nodes, streams and instruments."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.instruments import curves, position, pricing
from tidemark.plans import node
from tidemark.sources.store import PanelStore
from tidemark.streaming import live

T0 = datetime(2024, 1, 30)
D = timedelta(days=1)


def panel(spark, rows):
    return spark.createDataFrame([(T0 + t * D, k, v) for t, k, v in rows], "time_index timestamp, unique_identifier string, v double")


@pytest.fixture
def store(spark, tmp_path):
    return PanelStore(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted((r.time_index.day, r.unique_identifier, r.v) for r in df.collect())


def test_store(spark, store):
    assert store.read("none") is None and not store.exists("none") and store.names() == []
    t = store.upsert(panel(spark, [(0, "a", 1.0), (3, "a", 2.0)]), "x")
    assert [p for p, _ in t.parts] == ["202401", "202402"]
    before = dict(t.parts)
    t = store.upsert(panel(spark, [(3, "a", None), (4, "b", 5.0)]).withColumn("w", F.lit(1)), "x")
    assert dict(t.parts)["202401"] == before["202401"]
    assert rows(store.scan("x")) == [(2, "a", 2.0), (3, "b", 5.0), (30, "a", 1.0)]
    assert store.scan("x").where("w = 1").count() == 2
    assert rows(store.read("x", start=datetime(2024, 2, 1), ids=["b"])) == [(3, "b", 5.0)]
    assert store.upsert(panel(spark, []), "x").parts == t.parts
    added = store.upsert(panel(spark, [(5, "c", 6.0)]), "x")
    assert set(t.parts) < set(added.parts) and [p for p, _ in added.parts] == ["202401", "202402", "202402"]
    assert store.scan("x").where("unique_identifier = 'c' AND w IS NULL").count() == 1
    assert len(store.upsert(panel(spark, [(5, "c", 7.0)]), "x").parts) == 2
    store.upsert(panel(spark, [(5, "c", None)]), "x", mode="replace")
    assert (4, "c", None) in [(r.time_index.day, r.unique_identifier, r.v) for r in store.scan("x").collect()]
    with pytest.raises(ValueError):
        store.upsert(panel(spark, [(0, "a", 1.0), (0, "a", 2.0)]), "x")
    store.upsert(panel(spark, [(0, "a", 1.0), (0, "a", 2.0)]), "x", order=["v"])
    assert (30, "a", 2.0) in rows(store.scan("x"))
    assert store.drop_columns("x", ["w", "time_index", "zzz"]) == {"dropped": ["w"], "skipped": ["time_index", "zzz"], "partitions_rebuilt": 2}
    assert "w" not in store.scan("x").columns
    store.compact("x")
    assert store.vacuum("x") > 0 and store.scan("x").count() == 4
    assert store.capped("x", max_rows=1).count() == 1 and store.capped("x").count() == 4
    assert {(r.unique_identifier, r.is_total) for r in store.minima("x").collect()} == {(None, True), ("a", False), ("b", False), ("c", False)}
    store.view("x", "x_view")
    assert spark.sql("SELECT count(*) FROM x_view").first()[0] == 4
    assert store.reconcile(spark.createDataFrame([("y",)], "name string")) == {"only_local": ["x"], "only_remote": ["y"]}
    store.drop("x", files=True)
    assert store.names() == []


def test_nodes(spark, store):
    class Prices(node.DataNode):
        def update(self, context):
            return panel(spark, [(t, "a", float(t)) for t in range(self.arguments["n"])])

    class Doubled(node.DataNode):
        ignored = ("note",)

        def dependencies(self):
            return {"prices": self.arguments["prices"]}

        def update(self, context):
            return context.tables["prices"].withColumn("v", F.col("v") * 2)

    p = Prices(n=3)
    d = Doubled(prices=p, note="x")
    assert d.storage_name == Doubled(prices=p, note="y").storage_name and d.update_name != Doubled(prices=p, note="y").update_name
    assert [n.storage_name for n in node.order([d])] == [p.storage_name, d.storage_name]
    assert node.run(store, d) == [p.storage_name, d.storage_name]
    assert node.run(store, d) == []
    assert sorted(r.v for r in store.scan(d.storage_name).collect()) == [0.0, 2.0, 4.0]

    loop = node.FunctionNode("loop", lambda c: None)
    loop.needs["me"] = loop
    with pytest.raises(ValueError):
        node.order([loop])


def test_wrapper_needs_rules(spark):
    e = spark.createDataFrame([("g", 1)], "unique_identifier string, group_id int")
    a = spark.createDataFrame([("s", 1, "x")], "unique_identifier string, group_id int, exchange string")
    with pytest.raises(ValueError):
        node.wrapped_read(lambda t: None, e, a, [node.Rule(F.lit(False), "t")])
    with pytest.raises(ValueError):
        node.wrapped_read(lambda t: None, e, a.union(a), [node.Rule(F.lit(True), "t", "x")])


def test_stream(spark, store, tmp_path):
    src = f"{tmp_path}/in"
    panel(spark, [(0, "a", 1.0), (1, "a", 2.0)]).write.parquet(src)
    read = lambda: spark.readStream.schema(panel(spark, []).schema).parquet(src)
    live.upsert_stream(read(), store, "s", f"{tmp_path}/ck").awaitTermination()
    panel(spark, [(1, "a", 3.0), (2, "b", 4.0)]).write.mode("append").parquet(src)
    live.upsert_stream(read(), store, "s", f"{tmp_path}/ck").awaitTermination()
    assert rows(store.scan("s")) == [(1, "b", 4.0), (30, "a", 1.0), (31, "a", 3.0)]
    assert live.tumbling(read(), "1 day", "v", delay="1 day").isStreaming and live.deduplicated(read(), "1 day").isStreaming


def test_curve(spark):
    nodes = spark.createDataFrame([("c", 90, 0.04), ("c", 360, 0.05), ("c", -5, 1.0)], "curve_id string, days int, zero double")
    at = spark.createDataFrame([("c", d) for d in (0, 90, 360, 225)], "curve_id string, days int")
    df = {r.days: r.df for r in curves.discounted(at, nodes).collect()}
    assert df[0] == 1 and df[90] == pytest.approx(1 / 1.01) and df[360] == pytest.approx(1 / 1.05)
    assert df[225] == pytest.approx(math.sqrt(df[90] * df[360]))
    up = curves.bumped(nodes, 0.01, {90: 0.001}).where("days = 90").first().zero
    assert up == pytest.approx(0.051)
    quotes = spark.createDataFrame([("c", "deposit", 91, 0.04), ("c", "swap", 364, 0.05)], "curve_id string, kind string, days int, rate double")
    boot = curves.bootstrap(quotes)
    paid = spark.createDataFrame([("c", 182), ("c", 364)], "curve_id string, days int")
    f = {r.days: r.df for r in curves.discounted(paid, boot).collect()}
    tau = 182 / 360
    assert 0.05 * tau * (f[182] + f[364]) + f[364] == pytest.approx(1, abs=2e-4)


V = date(2024, 1, 1)


def test_bond(spark):
    b = spark.createDataFrame([("b", 100.0, 0.06, date(2024, 1, 1), date(2026, 1, 1), 6, "c")], "ins_id string, face double, coupon double, start_date date, end_date date, months int, curve_id string")
    nodes = spark.createDataFrame([("c", 1, 0.0), ("c", 3650, 0.0)], "curve_id string, days int, zero double")
    flows = pricing.bond_cashflows(b, "30/360")
    assert flows.count() == 5 and flows.agg(F.sum("amount")).first()[0] == pytest.approx(112.0, abs=0.1)
    p = pricing.bond_prices(b, nodes, F.lit(V), "30/360").first()
    assert p.npv == pytest.approx(112.0, abs=0.1) and p.accrued == 0 and p.clean == p.dirty
    y = pricing.yields(flows, spark.createDataFrame([("b", 100.0)], "ins_id string, value double"), F.lit(V)).first()["yield"]
    assert y == pytest.approx(2 * math.log(1.03), abs=5e-4)


def test_par_swap(spark):
    nodes = spark.createDataFrame([("c", 360, 0.05), ("c", 1080, 0.05)], "curve_id string, days int, zero double")
    s = spark.createDataFrame([("s", 1e6, 0.05, date(2024, 1, 1), date(2026, 1, 1), 6, "c")], "ins_id string, notional double, fixed_rate double, start_date date, end_date date, months int, curve_id string")
    flows = pricing.swap_cashflows(s, nodes, F.lit(V))
    by_leg = {r.leg: r.v for r in flows.groupBy("leg").agg(F.sum("amount").alias("v")).collect()}
    assert by_leg["fixed"] < 0 < by_leg["floating"]
    npv = pricing.present_value(flows.where("leg = 'floating'"), s, nodes, F.lit(V)).first().npv
    end = curves.discounted(spark.createDataFrame([("c", 731)], "curve_id string, days int"), nodes).first().df
    assert npv == pytest.approx(1e6 * (1 - end), rel=1e-3)


def _bs(s, k, t, v, r, q, call):
    n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    c = s * math.exp(-q * t) * n(d1) - k * math.exp(-r * t) * n(d2)
    return c if call else c - s * math.exp(-q * t) + k * math.exp(-r * t)


def test_options(spark):
    o = spark.createDataFrame([(100.0, 95.0, 0.5, 0.2, 0.03, 0.01, c) for c in (True, False)], "spot double, strike double, years double, volatility double, rate double, carry double, is_call boolean")
    for r in pricing.option_prices(o).collect():
        assert r.price == pytest.approx(_bs(100, 95, 0.5, 0.2, 0.03, 0.01, r.is_call), abs=1e-9)
        e = 1e-4
        bump = lambda **kw: _bs(*({"s": 100, "k": 95, "t": 0.5, "v": 0.2, "r": 0.03, "q": 0.01, "call": r.is_call} | kw).values())  # noqa: E731, B023
        assert r.delta == pytest.approx((bump(s=100 + e) - bump(s=100 - e)) / (2 * e), abs=1e-5)
        assert r.vega == pytest.approx((bump(v=0.2 + e) - bump(v=0.2 - e)) / (2 * e) / 100, abs=1e-5)
        assert r.rho == pytest.approx((bump(r=0.03 + e) - bump(r=0.03 - e)) / (2 * e) / 100, abs=1e-5)
        assert r.theta == pytest.approx(-(bump(t=0.5 + e) - bump(t=0.5 - e)) / (2 * e) / 365, abs=1e-5)


def test_knock_out(spark):
    rows = [(100.0, 100.0, h, 1.0, 0.2, 0.05, 0.0, c) for h in (1e-3, 80.0, 99.999, 120.0, 1e6) for c in (True, False)]
    o = spark.createDataFrame(rows, "spot double, strike double, barrier double, years double, vol double, rate double, carry double, is_call boolean")
    c = F.col
    out = {(r.barrier, r.is_call): r.p for r in o.withColumn("p", pricing.knock_out(c("spot"), c("strike"), c("barrier"), c("years"), c("vol"), c("rate"), c("carry"), c("is_call"))).collect()}
    assert out[(1e-3, True)] == pytest.approx(_bs(100, 100, 1, 0.2, 0.05, 0, True), abs=1e-6)
    assert out[(1e6, False)] == pytest.approx(_bs(100, 100, 1, 0.2, 0.05, 0, False), abs=1e-6)
    assert out[(99.999, True)] == pytest.approx(0, abs=0.01)
    assert 0 < out[(80.0, True)] < _bs(100, 100, 1, 0.2, 0.05, 0, True)
    assert 0 < out[(120.0, True)] < out[(1e6, True)]


def test_position(spark):
    flows = spark.createDataFrame([("a", "x", date(2024, 1, 2), 5.0), ("b", "x", date(2024, 1, 2), 7.0), ("a", "x", date(2024, 1, 1), 9.0), ("a", "x", None, 1.0)], "ins_id string, leg string, payment_date date, amount double")
    pos = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "ins_id string, units double")
    assert position.carry(flows, pos, F.lit(V), F.lit(date(2024, 1, 2))).first().carry == 3.0
    assert {r.payment_date: r.amount for r in position.cashflows_by_leg(flows, pos, F.lit(V)).collect()} == {V: 20.0, date(2024, 1, 2): 3.0}
    g = spark.createDataFrame([("a", {"delta": 1.0}), ("b", {"delta": 3.0, "vega": 1.0})], "ins_id string, greeks map<string,double>")
    assert {r.name: r.value for r in position.greeks(g, pos).collect()} == {"delta": -1.0, "vega": -1.0}


def test_spread_and_floater(spark):
    b = spark.createDataFrame([("b", 100.0, 0.06, 0.0, date(2024, 1, 1), date(2026, 1, 1), 6, "c")], "ins_id string, face double, coupon double, margin double, start_date date, end_date date, months int, curve_id string")
    nodes = spark.createDataFrame([("c", 360, 0.05), ("c", 1080, 0.05)], "curve_id string, days int, zero double")
    flows = pricing.bond_cashflows(b)
    worth = pricing.present_value(flows, b, nodes, F.lit(V), 0.01).select("ins_id", F.col("npv").alias("value"))
    assert pricing.spreads(flows, b, nodes, worth, F.lit(V)).first().spread == pytest.approx(0.01, abs=1e-9)
    floater = pricing.floating_bond_cashflows(b, nodes, F.lit(V))
    assert pricing.present_value(floater, b, nodes, F.lit(V)).first().npv == pytest.approx(100, abs=0.2)


def test_portfolio_plan(spark):
    from tidemark.plans import portfolio as plan

    days = [datetime(2024, 1, 1) + i * D for i in range(6)]
    prices = spark.createDataFrame([(d, k, p * (1 + 0.1 * i), 1.0) for i, d in enumerate(days) for k, p in (("a", 10.0), ("b", 20.0))], "time_index timestamp, unique_identifier string, close double, volume double")
    weights = spark.createDataFrame([(d, k, w) for d in days for k, w in (("a", 0.5), ("b", 0.5))], "time_index timestamp, unique_identifier string, signal_weight double")
    config = plan.PortfolioConfig.of({"signal": "fixed", "fee": 0.01, "forward_fill": "2 DAYS"})
    out = plan.build(config, weights, prices, weights.select("time_index").distinct()).orderBy("time_index").collect()
    assert [r["return"] for r in out] == pytest.approx([-0.01, 0.1, 0.1 / 1.1, 0.1 / 1.2, 0.1 / 1.3, 0.1 / 1.4])
    assert out[-1].close == pytest.approx(0.99 * 1.5) and out[0].rebalance_weights == '{"a":0.5,"b":0.5}'
    moved = plan.build(plan.PortfolioConfig.of({"signal": "fixed", "override_asset": "a"}), weights, prices, weights.select("time_index").distinct(), keep_maps=False)
    assert [r.close for r in moved.orderBy("time_index").collect()] == pytest.approx([10.0, 11.0, 12.0, 13.0, 14.0, 15.0])
    with pytest.raises(ValueError):
        plan.PortfolioConfig.of({"nothing": 1})
    with pytest.raises(ValueError):
        plan.PortfolioConfig.of({"signal": "unknown"})


def test_latest(spark):
    assert rows(live.latest(panel(spark, [(0, "a", 1.0), (1, "a", 2.0), (0, "b", 3.0)]))) == [(30, "b", 3.0), (31, "a", 2.0)]
