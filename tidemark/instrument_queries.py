"""Queries of cubic curves and of positions that mix types of instruments, registered with those of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .instruments import cubic, mixed, position
from .model_queries import _det
from .more_queries import _PHI
from .queries import query, r6, table, untied

# -- curves of each supplier from the mean discounts of its lines

_TENORS = {1: ("deposit", 30), 2: ("deposit", 91), 3: ("deposit", 182), 4: ("swap", 364), 5: ("swap", 910), 6: ("swap", 1820), 7: ("swap", 3640)}
_GRID = {1: ("deposit", 91), 2: ("deposit", 182), 3: ("swap", 364), 4: ("swap", 546)}


def _quotes(spark, sf_dir, tenors: dict[int, tuple[str, int]]) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").isin(list(tenors)))
    rates = l.groupBy(F.col("l_suppkey").alias("curve_id"), "l_linenumber").agg((F.avg("l_discount") / 2).alias("rate"))
    at = lambda i: reduce(lambda c, k: c.when(F.col("l_linenumber") == k, tenors[k][i]), tenors, F)
    return rates.select("curve_id", at(0).alias("kind"), at(1).alias("days"), "rate")


@query(f"SELECT l_suppkey AS curve_id, x.days, round(avg(l_discount) / 2 + 1e-8, 6) AS rate, round(avg(l_discount) / 2 + 1e-8, 6) AS par FROM lineitem JOIN (VALUES {', '.join(f'({k}, {d})' for k, (_, d) in _TENORS.items())}) x(k, days) ON l_linenumber = k GROUP BY ALL")
def cubic_par_rates(spark, sf_dir):
    """Deposits and swaps, some with payments between quotes: every quote is at par on the curve built from all."""
    quotes = _quotes(spark, sf_dir, _TENORS)
    out = cubic.par_rates(quotes, cubic.cubic_curves(quotes))
    return out.select("curve_id", "days", untied("rate", "rate"), untied("par", "par"))


def _spline_sql() -> str:
    """Natural cubic through (0, 0) and four log factors, its bends by Cramer's rule on three equations."""
    t = [0, *(d for _, d in _GRID.values())]
    h = [float(b - a) for a, b in zip(t, t[1:], strict=False)]
    x = ["0", "x1", "x2", "x3", "x4"]
    side = [f"((({x[i + 2]}) - ({x[i + 1]})) / {h[i + 1]} - (({x[i + 1]}) - ({x[i]})) / {h[i]})" for i in range(3)]
    left = [[f"{(h[i] + h[i + 1]) / 3 if i == j else h[max(i, j)] / 6 if abs(i - j) == 1 else 0.0:.17g}::DOUBLE" for j in range(3)] for i in range(3)]
    m = ["0", *(f"({_det([[side[i] if j == k else left[i][j] for j in range(3)] for i in range(3)])} / {_det(left)})" for k in range(3)), "0"]
    piece = lambda i: f"(u * {x[i]} + v * {x[i + 1]} + ((u * u * u - u) * m{i} + (v * v * v - v) * m{i + 1}) * {h[i] ** 2} / 6)"
    case = " ".join(f"WHEN d <= {t[i + 1]} THEN {piece(i)}" for i in range(4))
    width = "CASE " + " ".join(f"WHEN d <= {t[i + 1]} THEN ({t[i + 1]} - d) / {h[i]}" for i in range(4)) + " ELSE 0 END"
    return f"""WITH q AS (SELECT l_suppkey AS curve_id, l_linenumber AS k, avg(l_discount) / 2 AS r FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
    w AS (SELECT curve_id, max(CASE WHEN k = 1 THEN r END) AS r1, max(CASE WHEN k = 2 THEN r END) AS r2, max(CASE WHEN k = 3 THEN r END) AS r3, max(CASE WHEN k = 4 THEN r END) AS r4 FROM q GROUP BY ALL HAVING count(*) = 4),
    a AS (SELECT *, 182 / 360.0::DOUBLE AS t, 1 / (1 + r1 * 91 / 360) AS f1, 1 / (1 + r2 * 182 / 360) AS f2 FROM w), b AS (SELECT *, (1 - r3 * t * f2) / (1 + r3 * t) AS f3 FROM a), c AS (SELECT *, (1 - r4 * t * (f2 + f3)) / (1 + r4 * t) AS f4 FROM b),
    l AS (SELECT curve_id, ln(f1) AS x1, ln(f2) AS x2, ln(f3) AS x3, ln(f4) AS x4 FROM c), s AS (SELECT *, {', '.join(f'{e} AS m{i}' for i, e in enumerate(m))} FROM l),
    p AS (SELECT s.*, d.d AS d, {width} AS u FROM s, (VALUES (0), (45), (91), (137), (273), (364), (455), (546), (700)) d(d)), z AS (SELECT *, 1 - u AS v FROM p)
    SELECT curve_id, d AS days, round(exp(CASE {case} ELSE x4 + ((x4 - x3) / {h[3]} + {h[3]} * m3 / 6) * (d - {t[4]}) END) + 1e-11, 9) AS df FROM z"""


@query(_spline_sql())
def cubic_factors(spark, sf_dir):
    """Factors on and between the points of curves quoted on the same four days, and beyond them."""
    quotes = _quotes(spark, sf_dir, _GRID)
    full = quotes.groupBy("curve_id").count().where(F.col("count") == len(_GRID)).select("curve_id")
    made = cubic.cubic_curves(quotes.join(full, "curve_id", "left_semi"))
    rows = made.select("curve_id", F.explode(F.array(*map(F.lit, (0, 45, 91, 137, 273, 364, 455, 546, 700)))).alias("days"))
    return cubic.cubic_discounted(rows, made).select("curve_id", "days", r6(F.col("df") + 1e-11, "df", 9))


# -- bonds of suppliers, swaps of orders, options of parts

_AT = "2024-03-01"
_FLOWS = f"""WITH bonds AS (SELECT 'b' || s_suppkey AS ins_id, s_suppkey % 5 - 2 AS units, 100.0 * (1 + s_suppkey % 5) AS face, 0.02 + 0.01 * (s_suppkey % 4) AS coupon FROM supplier),
    bp AS (SELECT * FROM (VALUES (DATE '2024-01-02', DATE '2024-07-02'), (DATE '2024-07-02', DATE '2025-01-02')) x(a, z)),
    bf AS (SELECT ins_id, 'fixed_bond' AS kind, units, 'coupon' AS leg, z, face * coupon * date_diff('day', a, z) / 360.0 AS amount FROM bonds, bp UNION ALL SELECT ins_id, 'fixed_bond', units, 'redemption', DATE '2025-01-02', face FROM bonds),
    sw AS (SELECT 'o' || o_orderkey AS ins_id, o_custkey % 5 - 2 AS units, o_totalprice AS notional, 0.03 + o_custkey % 4 * 0.01 AS rate, DATE '2024-01-02' + CAST(o_orderkey % 19 AS INTEGER) AS s FROM orders),
    sd AS (SELECT *, unnest([0, 1, 2]) AS i FROM sw), su AS (SELECT *, CAST(s + INTERVAL 6 MONTH * i AS DATE) AS d FROM sd), sa AS (SELECT *, d + CAST(CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS z FROM su),
    sp AS (SELECT *, lag(z) OVER (PARTITION BY ins_id ORDER BY i) AS a FROM sa), sq AS (SELECT *, date_diff('day', a, z) / 360.0 AS tau, greatest(date_diff('day', DATE '{_AT}', a), 0) AS n0, date_diff('day', DATE '{_AT}', z) AS n1 FROM sp WHERE i > 0),
    sf AS (SELECT ins_id, 'swap' AS kind, units, 'fixed' AS leg, z, -notional * rate * tau AS amount FROM sq UNION ALL SELECT ins_id, 'swap', units, 'floating', z, notional * tau * (exp(ln(1.05) * (n1 - n0) / 360.0) - 1) / ((n1 - n0) / 360.0) FROM sq),
    flows AS (SELECT * FROM bf UNION ALL SELECT * FROM sf),
    terms AS (SELECT 'p' || p_partkey AS ins_id, CASE p_partkey % 3 WHEN 0 THEN 'european_option' WHEN 1 THEN 'fx_option' ELSE 'knock_out' END AS kind, p_partkey % 5 - 2 AS units, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS size, p_retailprice AS s, p_retailprice * (0.9 + p_size % 5 * 0.05) AS k, p_retailprice * 0.8 AS b, 0.25 + p_size % 4 * 0.25 AS t, 0.15 + p_size % 3 * 0.1 AS v, 0.03::DOUBLE AS r, CASE p_partkey % 3 WHEN 1 THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END AS q, CASE WHEN p_partkey % 3 = 2 OR p_size % 2 = 0 THEN 1 ELSE -1 END AS g FROM part),
    td AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(b * b / (s * k)) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS y1, (r - q - v * v / 2) / (v * v) AS mu FROM terms),
    tn AS (SELECT *, {_PHI.format(x='(g * d1)')} AS n1, {_PHI.format(x='(g * (d1 - v * sqrt(t)))')} AS n2, {_PHI.format(x='y1')} AS c1, {_PHI.format(x='(y1 - v * sqrt(t))')} AS c2 FROM td),
    opt AS (SELECT *, g * (s * exp(-q * t) * n1 - k * exp(-r * t) * n2) - CASE WHEN kind = 'knock_out' THEN s * exp(-q * t) * pow(b / s, 2 * (mu + 1)) * c1 - k * exp(-r * t) * pow(b / s, 2 * mu) * c2 ELSE 0 END AS price FROM tn),
    priced AS (SELECT ins_id, kind, units, sum(CASE WHEN z > DATE '{_AT}' THEN amount * exp(-ln(1.05) * date_diff('day', DATE '{_AT}', z) / 360.0) ELSE 0 END) AS price FROM flows GROUP BY ALL UNION ALL SELECT ins_id, kind, units, size * greatest(price, 0) FROM opt)"""


def _held(spark, sf_dir) -> tuple[DataFrame, DataFrame, mixed.Market]:
    """Instruments of five kinds in one table, the units held of each, and the market."""
    c, lit = F.col, F.lit
    b, o, p = (table(spark, sf_dir, n) for n in ("supplier", "orders", "part"))
    day = lambda s: lit(s).cast("date")
    bonds = b.select(F.concat(lit("b"), "s_suppkey").alias("ins_id"), lit("fixed_bond").alias("kind"), (c("s_suppkey") % 5 - 2).cast("double").alias("units"), (100.0 * (1 + c("s_suppkey") % 5)).alias("face"), (0.02 + 0.01 * (c("s_suppkey") % 4)).alias("coupon"), day("2024-01-02").alias("start_date"), day("2025-01-02").alias("end_date"), lit(6).alias("months"), lit("c").alias("curve_id"))
    start = F.date_add(day("2024-01-02"), (c("o_orderkey") % 19).cast("int"))
    swaps = o.select(F.concat(lit("o"), "o_orderkey").alias("ins_id"), lit("swap").alias("kind"), (c("o_custkey") % 5 - 2).cast("double").alias("units"), c("o_totalprice").cast("double").alias("notional"), (0.03 + c("o_custkey") % 4 * 0.01).alias("fixed_rate"), start.alias("start_date"), F.add_months(start, 12).alias("end_date"), lit(6).alias("months"), lit("c").alias("curve_id"))
    of = c("p_partkey") % 3
    kind = F.when(of == 0, "european_option").when(of == 1, "fx_option").otherwise("knock_out")
    options = p.select(
        F.concat(lit("p"), "p_partkey").alias("ins_id"), kind.alias("kind"), (c("p_partkey") % 5 - 2).cast("double").alias("units"), F.when(of != 0, 100.0).alias("notional"), c("p_retailprice").alias("spot"), (c("p_retailprice") * (0.9 + c("p_size") % 5 * 0.05)).alias("strike"),
        F.when(of == 2, c("p_retailprice") * 0.8).alias("barrier"), F.when(of == 2, "down_and_out").alias("barrier_type"), (0.25 + c("p_size") % 4 * 0.25).alias("years"), (0.15 + c("p_size") % 3 * 0.1).alias("volatility"), lit(0.03).alias("rate"), F.when(of == 1, 0.02).otherwise(0.01).alias("carry"), ((of == 2) | (c("p_size") % 2 == 0)).alias("is_call"),
    )
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [bonds, swaps, options])
    nodes = spark.createDataFrame([("c", 360, 0.05)], "curve_id string, days int, zero double")
    return rows.drop("units"), rows.select("ins_id", "units"), mixed.Market(day(_AT), nodes)


_KINDS = ("fixed_bond", "swap", "european_option", "fx_option", "knock_out")


@query(_FLOWS + " SELECT ins_id, kind, CAST(units AS DOUBLE) AS units, round(price, 5) + 0.0 AS price, round(price * units, 5) + 0.0 AS value FROM priced")
def mixed_prices(spark, sf_dir):
    """Bonds, swaps, European, currency and knock-out options priced in one plan, each by its kernel."""
    rows, held, market = _held(spark, sf_dir)
    out = position.price_breakdown(mixed.prices(rows, market, kinds=_KINDS), held)
    return out.join(rows.select("ins_id", "kind"), "ins_id").select("ins_id", "kind", "units", r6("price", "price", 5), r6("value", "value", 5))


@query(_FLOWS + " SELECT leg, CAST(z AS VARCHAR) AS payment_date, round(sum(amount * units), 2) + 0.0 AS amount FROM flows GROUP BY ALL")
def mixed_cashflows(spark, sf_dir):
    """Flows of all kinds that have them, by leg and day, in units held."""
    rows, held, market = _held(spark, sf_dir)
    flows = mixed.cashflows(rows, market, kinds=_KINDS)
    return position.cashflows_by_leg(flows, held, market.valuation).select("leg", F.col("payment_date").cast("string").alias("payment_date"), r6("amount", "amount", 2))


@query(_FLOWS + """, x AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS phi FROM tn WHERE kind <> 'knock_out'), y AS (SELECT units * size AS n, 'delta' AS name, g * exp(-q * t) * n1 AS v FROM x UNION ALL SELECT units * size, 'gamma', exp(-q * t) * phi / (s * v * sqrt(t)) FROM x UNION ALL SELECT units * size, 'vega', s * exp(-q * t) * phi * sqrt(t) / 100 FROM x
    UNION ALL SELECT units * size, 'rho', g * k * t * exp(-r * t) * n2 / 100 FROM x UNION ALL SELECT units * size, 'theta', (-s * exp(-q * t) * phi * v / (2 * sqrt(t)) - g * r * k * exp(-r * t) * n2 + g * q * s * exp(-q * t) * n1) / 365 FROM x)
    SELECT name, round(sum(n * v), 3) + 0.0 AS value FROM y GROUP BY ALL""")
def mixed_greeks(spark, sf_dir):
    """Greeks of the position's European and currency options, summed in units held; flows have none."""
    rows, held, market = _held(spark, sf_dir)
    out = position.greeks(mixed.greeks(rows.where("kind <> 'knock_out'"), market, kinds=_KINDS), held)
    return out.select("name", r6("value", "value", 3))
