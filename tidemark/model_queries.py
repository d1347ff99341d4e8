"""Queries of rolling models with several factors or components, refits by schedule and replication, registered with those of queries."""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .instruments import pricing
from .operators import calendars, merge, models, portfolio, signals
from .queries import query, r6, table
from .schema import KEY, TIME

_D3 = """WITH d AS (SELECT l_shipdate AS time_index, 's' || l_suppkey AS unique_identifier, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_tax * 100 + 1 AS tax, l_discount * 100 + 1 AS discount FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_shipdate, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)"""


def _d3(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias(TIME), F.concat(F.lit("s"), F.col("l_suppkey")).alias(KEY), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), (F.col("l_tax") * 100 + 1).alias("tax"), (F.col("l_discount") * 100 + 1).alias("discount"), "l_orderkey", "l_linenumber")
    return merge.keep_one(p, ["l_orderkey", "l_linenumber"], colocate=(KEY,)).drop("l_orderkey", "l_linenumber")


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(("- " if j % 2 else "+ ") + f"{m[0][j]} * {_det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"


def _nnls_sql(source: str, y: str, xs: list[str], n: int, by: str = "unique_identifier") -> str:
    """Non-negative least squares by trying every subset of the factors: of those with positive solutions the one with the least error."""
    k = range(len(xs))
    low = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    sums = [f"sum({xs[i]} * {xs[j]}) OVER w AS g{i}{j}" for i in k for j in k if i <= j] + [f"sum({x} * {y}) OVER w AS c{i}" for i, x in enumerate(xs)]
    tries = []
    for size in range(len(xs) + 1):
        for s in combinations(k, size):
            m = [[low(i, j) for j in s] for i in s]
            b = {}
            for p, v in enumerate(s):
                b[v] = f"{_det([[f'c{i}' if q == p else low(i, j) for q, j in enumerate(s)] for i in s])} / {_det(m)}"
            gain = " + ".join(f"c{v} * {b[v]}" for v in s) or "0"
            tries.append("{" + ", ".join(f"'b{v}': {b.get(v, '0::DOUBLE')}" for v in k) + f", 'gain': ({gain})::DOUBLE}}")
    part = f"PARTITION BY {by} " if by else ""
    return f"""{source}, o AS (SELECT *, count(*) OVER w AS n, {', '.join(sums)} FROM rows_in WINDOW w AS ({part}ORDER BY time_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
    t AS (SELECT *, unnest([{', '.join(tries)}]) AS s FROM o WHERE n = {n}),
    z AS (SELECT time_index{', ' + by if by else ''}, arg_max(s, s.gain) AS s FROM t WHERE {' AND '.join(f's.b{v} >= 0' for v in k)} GROUP BY ALL)"""


@query(_nnls_sql(_D3 + ", rows_in AS (SELECT * FROM d)", "price", ["volume", "tax", "discount"], 20) + " SELECT time_index, unique_identifier, round(s.b0 + 1e-8, 4) AS volume, round(s.b1 + 1e-8, 4) AS tax, round(s.b2 + 1e-8, 4) AS discount FROM z")
def rolling_nnls_factors(spark, sf_dir):
    """Non-negative least squares on three factors."""
    names = ["volume", "tax", "discount"]
    out = models.rolling_regression(_d3(spark, sf_dir), "price", names, 20).where("weights IS NOT NULL")
    return out.select(TIME, KEY, *(r6(F.col("weights")[c] + 1e-8, c, 4) for c in names))


_PCA = _D3 + """, x AS (SELECT time_index, unique_identifier, price AS a, volume * 40 AS b, tax * 100 AS c FROM d),
    m AS (SELECT time_index, unique_identifier, count(*) OVER w AS n, var_samp(a) OVER w AS aa, var_samp(b) OVER w AS bb, var_samp(c) OVER w AS cc, covar_samp(a, b) OVER w AS ab, covar_samp(a, c) OVER w AS ac, covar_samp(b, c) OVER w AS bc FROM x WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, (aa + bb + cc) / 3 AS q FROM m WHERE n = 24), p AS (SELECT *, sqrt(((aa - q) * (aa - q) + (bb - q) * (bb - q) + (cc - q) * (cc - q) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM q),
    f AS (SELECT *, acos(least(1, greatest(-1, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / (2 * p * p * p)))) / 3 AS phi FROM p),
    e AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f)"""


@query(_PCA + " SELECT time_index, unique_identifier, round(e1 / (3 * q), 6) AS share1, round((3 * q - e1 - e3) / (3 * q), 6) AS share2, round(e3 / (3 * q) + 1e-9, 6) AS share3, true AS solves, true AS signed FROM e")
def rolling_pca_components(spark, sf_dir):
    """Three components of the window before each row; every one is held against the covariances: C v = variance v."""
    names = ["a", "b", "c"]
    x = _d3(spark, sf_dir).select(TIME, KEY, F.col("price").alias("a"), (F.col("volume") * 40).alias("b"), (F.col("tax") * 100).alias("c"))
    out = models.rolling_pca(x, names, 24, components=3, inclusive=False)
    w = Window.partitionBy(KEY).orderBy(TIME).rowsBetween(-24, -1)
    out = out.withColumns({f"{i}{j}": F.covar_samp(i, j).over(w) for i in names for j in names if i <= j}).where("components IS NOT NULL")
    trace = F.col("aa") + F.col("bb") + F.col("cc")
    part = lambda k: F.get("components", F.lit(k))
    cov = lambda i, j: F.col(min(i, j) + max(i, j))
    residual = [F.abs(sum((cov(i, j) * part(k)["loadings"][j] for j in names), F.lit(0.0)) - part(k)["variance"] * part(k)["loadings"][i]) for k in range(3) for i in names]
    total = [sum((F.abs(part(k)["loadings"][j]) for j in names), F.lit(0.0)) for k in range(3)]
    signed = [(F.abs(t - 1) < 1e-9) & (sum((part(k)["loadings"][j] for j in names), F.lit(0.0)) >= 0) for k, t in enumerate(total)]
    return out.select(TIME, KEY, *(r6(part(k)["variance"] / trace + (1e-9 if k == 2 else 0), f"share{k + 1}") for k in range(3)), (F.greatest(*residual) < 1e-8 * trace).alias("solves"), (signed[0] & signed[1] & signed[2]).alias("signed"))


_REFIT = _D3 + """, t AS (SELECT *, lead(price) OVER (PARTITION BY unique_identifier ORDER BY time_index) / price - 1 AS target, date_diff('day', DATE '1970-01-01', CAST(time_index AS DATE)) // 90 AS period FROM d),
    k AS (SELECT * FROM t WHERE target IS NOT NULL),
    m AS (SELECT time_index, unique_identifier, period, lag(period) OVER o AS was, lag(time_index) OVER o AS trained, count(*) OVER w AS n, avg(target) OVER w AS my, avg(volume) OVER w AS m1, avg(tax) OVER w AS m2, var_pop(volume) OVER w AS s11, var_pop(tax) OVER w AS s22, covar_pop(volume, tax) OVER w AS s12, covar_pop(target, volume) OVER w AS s1, covar_pop(target, tax) OVER w AS s2 FROM k
      WINDOW o AS (PARTITION BY unique_identifier ORDER BY time_index), w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m WHERE n = 30 AND period <> was),
    g AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM f)"""


def _models(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Features and the models fitted on them once in 90 days."""
    d = _d3(spark, sf_dir)
    trained = models.training_table(d.select(TIME, KEY, "volume", "tax"), d, ["volume", "tax"], price="price")
    period = F.floor(F.datediff(F.col(TIME).cast("date"), F.lit("1970-01-01").cast("date")) / 90)
    return d, models.fit_schedule(trained, "target", ["volume", "tax"], 30, period, models.LinearModel())


@query(_REFIT + " SELECT time_index, unique_identifier, trained AS last_timestamp_on_train, n AS n_train, round(b0, 5) AS intercept, round(b1, 6) AS volume, round(b2, 5) AS tax FROM g")
def training_log(spark, sf_dir):
    """One model a supplier and quarter, on the 30 rows before."""
    _, log = _models(spark, sf_dir)
    return log.select(TIME, KEY, "last_timestamp_on_train", "n_train", r6("intercept", "intercept", 5), r6(F.col("coefficients")["volume"], "volume"), r6(F.col("coefficients")["tax"], "tax", 5))


@query(_REFIT + " SELECT d.time_index, d.unique_identifier, round(b0 + b1 * volume + b2 * tax, 4) AS predicted, g.time_index AS fitted_at FROM d ASOF LEFT JOIN g ON d.unique_identifier = g.unique_identifier AND d.time_index >= g.time_index")
def scheduled_predictions(spark, sf_dir):
    """Every row predicted by the last model at or before it."""
    d, log = _models(spark, sf_dir)
    out = models.predict(d.select(TIME, KEY, "volume", "tax"), log, ["volume", "tax"])
    return out.select(TIME, KEY, r6("predicted", "predicted", 4), "fitted_at")


_LINES = """WITH m AS (SELECT l_shipdate AS time_index, l_linenumber AS k, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY ALL), v AS (SELECT time_index, max(p) FILTER (k = 1) AS p0, max(p) FILTER (k = 2) AS p1, max(p) FILTER (k = 3) AS p2, max(p) FILTER (k = 4) AS p3 FROM m GROUP BY ALL HAVING p0 IS NOT NULL),
    f AS (SELECT time_index, """ + ", ".join(f"last_value(p{i} IGNORE NULLS) OVER o AS p{i}" for i in range(4)) + """ FROM v WINDOW o AS (ORDER BY time_index ROWS UNBOUNDED PRECEDING)),
    rows_in AS (SELECT time_index, """ + ", ".join(f"p{i} / lag(p{i}) OVER o - 1 AS r{i}" for i in range(4)) + " FROM f WINDOW o AS (ORDER BY time_index))"


@query(_nnls_sql(_LINES, "r0", ["r1", "r2", "r3"], 40, "") + " SELECT time_index, unnest(['n2', 'n3', 'n4']) AS unique_identifier, round(unnest([s.b0, s.b1, s.b2]) + 1e-8, 5) AS signal_weight FROM z")
def replication_weights(spark, sf_dir):
    """The price of one kind of line tracked by three others."""
    l = table(spark, sf_dir, "lineitem")
    prices = l.groupBy(F.col("l_shipdate").alias(TIME), F.concat(F.lit("n"), F.col("l_linenumber")).alias(KEY)).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    out = signals.replication_weights(prices, "n1", ["n2", "n3", "n4"], 40)
    return out.select(TIME, KEY, r6(F.col("signal_weight") + 1e-8, "signal_weight", 5))


@query(
    "WITH RECURSIVE" + _D3.removeprefix("WITH") + """, s AS (SELECT time_index, unique_identifier, 'p' || (CAST(substr(unique_identifier, 2) AS INT) % 3) AS portfolio, (quarter(time_index) % 3) * 0.2 - 0.1 AS target, 0.05 * price * volume / 60000 AS room, row_number() OVER (PARTITION BY unique_identifier ORDER BY time_index) AS rn FROM d),
    h AS (SELECT time_index, unique_identifier, portfolio, rn, least(greatest(target, -room), room) AS held FROM s WHERE rn = 1 UNION ALL SELECT s.time_index, s.unique_identifier, s.portfolio, s.rn, h.held + least(greatest(s.target - h.held, -s.room), s.room) FROM h JOIN s ON s.unique_identifier = h.unique_identifier AND s.rn = h.rn + 1)
    SELECT time_index, unique_identifier, portfolio, round(held + 1e-9, 6) AS weights FROM h"""
)
def volume_participation(spark, sf_dir):
    """Targets that change with the quarter, approached by a twentieth of each bar's dollar volume."""
    d = _d3(spark, sf_dir)
    frame = d.select(TIME, KEY, F.concat(F.lit("p"), (F.substring(KEY, 2, 9).cast("int") % 3).cast("string")).alias("portfolio"), ((F.quarter(TIME) % 3) * 0.2 - 0.1).alias("weights"), "price", "volume")
    out = portfolio.volume_participation(frame, 60000.0, 0.05)
    return out.select(TIME, KEY, "portfolio", r6(F.col("weights") + 1e-9, "weights"))


# -- business days and fixings


def _closed(*names: str) -> str:
    return ", ".join(f"DATE '{d}'" for d in sorted({d for name in names for y in range(1995, 2003) for d in calendars.EXCHANGES[name][0](y)}))


_OPEN = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 91 AS b FROM orders),
    y AS (SELECT d, isodow(d) < 6 AND d NOT IN ({_closed('XNYS')}) AS ny, isodow(d) < 6 AND d NOT IN ({_closed('XNYS', 'XLON')}) AS two FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d)),
    f AS (SELECT d, min(CASE WHEN ny THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS next, max(CASE WHEN ny THEN d END) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS prev FROM y)"""


@query(_OPEN + """ SELECT o_orderkey, CAST(f.next AS VARCHAR) AS following, CAST(CASE WHEN month(g.next) = month(b) THEN g.next ELSE g.prev END AS VARCHAR) AS modified, CAST((SELECT list_sort(list(d))[3] FROM y WHERE two AND d BETWEEN a AND a + 20) AS VARCHAR) AS spot, (SELECT count(*) FROM y WHERE ny AND d > a AND d <= b) AS n_days
    FROM o JOIN f ON f.d = a JOIN f AS g ON g.d = b""")
def business_day_schedule(spark, sf_dir):
    """Orders' dates on the New York calendar, and spot dates on which London is open as well."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a")).withColumn("b", F.date_add("a", 91))
    ny, both = (calendars.open_days(spark, date(1995, 1, 1), date(2002, 12, 31), *names) for names in (("XNYS",), ("XNYS", "XLON")))
    o = calendars.rolled(o, ny, "a", "following", "FOLLOWING")
    o = calendars.rolled(o, ny, "b", "modified")
    o = calendars.moved(o, both, "a", 2, "spot")
    o = calendars.counted(o, ny, "a", "b", "n_days")
    return o.select("o_orderkey", *(F.col(c).cast("string").alias(c) for c in ("following", "modified", "spot")), "n_days")


_SWAPS = """WITH x AS (SELECT o_orderkey AS ins_id, o_totalprice AS notional, CAST(o_orderdate AS DATE) AS start_date, 'c' || (o_custkey % 5) AS curve_id FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
    r AS (SELECT 'c' || (l_suppkey % 5) AS curve_id, CAST(l_shipdate AS DATE) AS d, avg(l_discount) / 2 AS rate FROM lineitem WHERE dayofmonth(l_shipdate) % 3 = 0 GROUP BY ALL),"""


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Half-year spans of orders, and fixings by curve on every third day of the month."""
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP '1998-06-01'")
    spans = o.select("o_orderkey", F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("curve_id"), F.col("o_orderdate").cast("date").alias("period_start")).withColumn("period_end", F.date_add("period_start", 182))
    l = table(spark, sf_dir, "lineitem").where("dayofmonth(l_shipdate) % 3 = 0")
    fixings = l.groupBy(F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("curve_id"), F.col("l_shipdate").cast("date").alias("fixing_date")).agg((F.avg("l_discount") / 2).alias("rate"))
    return spans, fixings


@query(_SWAPS + """ n AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY curve_id ORDER BY d), DATE '2100-01-01') AS next FROM r),
    g AS (SELECT ins_id, product(1 + rate * date_diff('day', greatest(d, start_date), least(next, start_date + 182)) / 360.0) AS grown FROM x JOIN n ON x.curve_id = n.curve_id AND next > start_date AND d < start_date + 182 GROUP BY ALL)
    SELECT x.ins_id AS o_orderkey, round(coalesce(grown, 1), 8) AS grown FROM x LEFT JOIN g USING (ins_id)""")
def overnight_growth(spark, sf_dir):
    """What overnight fixings make of 1 over half a year from each order's date."""
    spans, fixings = _spans(spark, sf_dir)
    grown = pricing.growth(spans.select("curve_id", "period_start", "period_end").distinct(), fixings)
    return spans.join(grown, ["curve_id", "period_start", "period_end"]).select("o_orderkey", r6("grown", "grown", 8))
