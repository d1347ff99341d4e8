"""Cubic curves against a plain spline and fixed points; mixed positions against each type priced alone."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.instruments import cubic, mixed, position, pricing

V = date(2024, 3, 1)
QUOTES = "curve_id string, kind string, days int, rate double"


def _plain(points, day):
    """Natural cubic through points, its bends by elimination, one point at a time."""
    t, y = [p[0] for p in points], [p[1] for p in points]
    n = len(t)
    a = np.eye(n)
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = [t[i] - t[i - 1], 2 * (t[i + 1] - t[i - 1]), t[i + 1] - t[i]]
        r[i] = 6 * ((y[i + 1] - y[i]) / (t[i + 1] - t[i]) - (y[i] - y[i - 1]) / (t[i] - t[i - 1]))
    m = np.linalg.solve(a, r)
    for i in range(n - 1):
        if day <= t[i + 1]:
            h = t[i + 1] - t[i]
            return (m[i] * (t[i + 1] - day) ** 3 + m[i + 1] * (day - t[i]) ** 3) / (6 * h) + (y[i] / h - m[i] * h / 6) * (t[i + 1] - day) + (y[i + 1] / h - m[i + 1] * h / 6) * (day - t[i])


def _rates(n, seed):
    rng = np.random.default_rng(seed)
    grid = [("deposit", 30), ("deposit", 91), ("deposit", 182), ("swap", 364), ("swap", 800), ("swap", 1820), ("swap", 3640)]
    return [(f"c{i}", k, d, float(0.03 + 0.01 * rng.random())) for i in range(n) for k, d in grid[: 1 + i % 7]]


def test_quotes_are_at_par(spark):
    quotes = spark.createDataFrame(_rates(21, 1), QUOTES)
    made = cubic.cubic_curves(quotes)
    out = cubic.par_rates(quotes, made).collect()
    assert len(out) == len(_rates(21, 1)) and max(abs(r.par - r.rate) for r in out) < 1e-10
    assert made.count() == 21


def test_spline_and_iteration_against_fixed_points(spark):
    """The same curve from bootstrapping again and again with the factors between quotes taken from the last round's spline."""
    rows = _rates(7, 5)[-7:]
    x = {d: -math.log1p(r * d / 360) for _, _, d, r in rows}
    for _ in range(400):
        points = [(0.0, 0.0), *sorted(x.items())]
        new = dict(x)
        for _, kind, d, r in rows:
            if kind == "swap":
                paid = [p for p in range(182, d, 182)]
                known = sum(182 / 360 * math.exp(_plain(points, p)) for p in paid)
                new[d] = math.log((1 - r * known) / (1 + r * (d - (paid[-1] if paid else 0)) / 360))
        x = new
    points = [(0.0, 0.0), *sorted(x.items())]
    at = [0, 1, 30, 60, 182, 300, 1000, 2500, 3640]
    made = cubic.cubic_curves(spark.createDataFrame(rows, QUOTES))
    got = {r.days: r.df for r in cubic.cubic_discounted(spark.createDataFrame([(rows[0][0], d) for d in at], "curve_id string, days int"), made).collect()}
    for d in at:
        assert got[d] == pytest.approx(math.exp(_plain(points, d)), abs=1e-11)


def test_beyond_the_last_point_and_odd_quotes(spark):
    rows = [("a", "deposit", 100, 0.05), ("a", "deposit", 100, 0.04), ("a", "swap", 0, 0.5), ("a", "deposit", -3, 0.5), ("a", "deposit", 200, None), ("a", "deposit", 300, float("nan")), ("bad", "swap", 364, -9.0), ("gone", "deposit", 5, None)]
    made = cubic.cubic_curves(spark.createDataFrame(rows, QUOTES))
    assert {r.curve_id: r.points is None for r in made.collect()} == {"a": False, "bad": True}
    at = spark.createDataFrame([("a", 100), ("a", 400), ("a", -5), ("a", None), ("bad", 5), (None, 5)], "curve_id string, days int")
    got = {(r.curve_id, r.days): r.df for r in cubic.cubic_discounted(at, made).collect()}
    one = 1 / (1 + 0.04 * 100 / 360)
    assert got["a", 100] == pytest.approx(one) and got["a", 400] == pytest.approx(one**4) and got["a", -5] == 1
    assert got["a", None] is None and got["bad", 5] is None and got[None, 5] is None
    assert cubic.cubic_curves(spark.createDataFrame([], QUOTES)).count() == 0
    with pytest.raises(Exception, match="no kind of quote: bond"):
        cubic.cubic_curves(spark.createDataFrame([("a", "bond", 5, 0.1)], QUOTES)).collect()


SCHEMA = "ins_id string, kind string, face double, coupon double, margin double, notional double, fixed_rate double, start_date date, end_date date, months int, curve_id string, spot double, strike double, barrier double, barrier_type string, years double, volatility double, rate double, carry double, is_call boolean"


def _row(ins_id, kind, **terms):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return tuple({"ins_id": ins_id, "kind": kind, **terms}.get(n) for n in names)


LEGS = {"start_date": date(2024, 1, 2), "end_date": date(2025, 1, 2), "months": 6, "curve_id": "c"}
OPTION = {"spot": 100.0, "strike": 95.0, "years": 0.5, "volatility": 0.2, "rate": 0.03, "carry": 0.01, "is_call": True}


@pytest.fixture
def market(spark):
    nodes = spark.createDataFrame([("c", 360, 0.05)], "curve_id string, days int, zero double")
    fixings = spark.createDataFrame([("c", date(2024, 1, 1), 0.06), ("c", date(2024, 2, 1), 0.07)], "curve_id string, fixing_date date, rate double")
    return mixed.Market(F.lit(V), nodes, fixings)


@pytest.fixture
def instruments(spark):
    rows = [
        _row("bond", "fixed_bond", face=100.0, coupon=0.04, **LEGS), _row("floater", "floating_bond", face=100.0, margin=0.01, **LEGS), _row("swap", "swap", notional=1e6, fixed_rate=0.04, **LEGS), _row("ois", "overnight_swap", notional=1e6, fixed_rate=0.04, **LEGS),
        _row("over", "fixed_bond", face=100.0, coupon=0.04, **(LEGS | {"start_date": date(2022, 1, 3), "end_date": date(2023, 1, 3)})), _row("call", "european_option", **OPTION), _row("fx", "fx_option", notional=1000.0, **(OPTION | {"is_call": False})),
        _row("out", "knock_out", notional=10.0, barrier=80.0, **OPTION), _row("up", "knock_out", barrier=130.0, barrier_type="up_and_out", **OPTION), _row("passed", "knock_out", barrier=101.0, barrier_type="down_and_out", **OPTION), _row("null", "european_option", **(OPTION | {"spot": None})),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_type_as_alone(spark, instruments, market):
    got = {r.ins_id: r.price for r in mixed.prices(instruments, market).collect()}
    alone = lambda flows, i: pricing.present_value(flows, instruments.where(F.col("ins_id") == i), market.nodes, market.valuation).first().npv
    own = lambda i: instruments.where(F.col("ins_id") == i)
    assert got["bond"] == pytest.approx(alone(pricing.bond_cashflows(own("bond")), "bond"))
    assert got["floater"] == pytest.approx(alone(pricing.floating_bond_cashflows(own("floater"), market.nodes, market.valuation), "floater"))
    assert got["swap"] == pytest.approx(alone(pricing.swap_cashflows(own("swap"), market.nodes, market.valuation, fixings=market.fixings), "swap"))
    assert got["ois"] == pytest.approx(alone(pricing.overnight_cashflows(own("ois"), market.nodes, market.valuation, market.fixings), "ois"))
    assert got["over"] == 0 and got["passed"] == 0 and got["null"] is None
    assert got["call"] == pytest.approx(pricing.option_prices(own("call").drop("notional")).first().price)
    assert got["fx"] == pytest.approx(pricing.option_prices(own("fx")).first().price)
    assert 0 < got["out"] / 10 <= got["call"] and 0 < got["up"] < got["call"]


def test_flows_and_greeks_of_types_that_have_them(spark, instruments, market):
    held = instruments.select("ins_id", F.lit(2.0).alias("units"))
    flows = mixed.cashflows(instruments, market)
    assert {r.kind for r in flows.select("kind").distinct().collect()} == {"fixed_bond", "floating_bond", "swap", "overnight_swap"}
    legs = {r.leg: r.a for r in position.cashflows_by_leg(flows, held, F.lit(V)).groupBy("leg").agg(F.sum("amount").alias("a")).collect()}
    assert legs["redemption"] == 600.0 and legs["fixed"] < 0 < legs["floating"]
    greeks = {r.ins_id: r.greeks for r in mixed.greeks(instruments, market).collect()}
    assert set(greeks) == {"call", "fx", "out", "up", "passed", "null"} and set(greeks["passed"].values()) == {0.0}
    # a barrier far below leaves a European option
    far = instruments.where("ins_id = 'out'").withColumns({"barrier": F.lit(1e-3), "notional": F.lit(None).cast("double")})
    near = mixed.greeks(far, market).first().greeks
    for k, v in greeks["call"].items():
        assert near[k] == pytest.approx(v, rel=2e-3, abs=1e-6), k


def test_unknown_types_own_kernels_and_nothing(spark, instruments, market):
    odd = instruments.where("ins_id = 'call'").withColumn("kind", F.lit("cat_bond"))
    with pytest.raises(Exception, match="no kernel for cat_bond"):
        mixed.prices(odd, market).collect()
    with pytest.raises(Exception, match="no kernel for null"):
        mixed.prices(odd.withColumn("kind", F.lit(None).cast("string")), market).collect()
    cat = mixed.Kernel(lambda rows, m: rows.select("ins_id", (F.col("spot") * 2).alias("price")))
    assert mixed.prices(odd, market, {"cat_bond": cat}).first().price == 200.0
    with pytest.raises(ValueError, match="has flows"):
        mixed.cashflows(odd, market, {"cat_bond": cat})
    empty = instruments.limit(0)
    assert mixed.prices(empty, market).count() == mixed.cashflows(empty, market).count() == mixed.greeks(empty, market).count() == 0
