"""Queries over the driver tables, and the same in SQL.

Panels: E, irregular events by user; P, line items as prices of suppliers with repeated keys; D, P with one row a key.
Doubles are rounded on both sides, as sums may be taken in any order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .instruments import curves, position
from .operators import bars, fill, merge, passes, portfolio, ranges, reshape, rolling, signals
from .operators import watermarks as wm
from .plans.node import Rule, wrapped_read
from .schema import KEY, TIME, by_key
from .streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

E_SQL = "WITH e AS (SELECT ts AS time_index, CAST(user_id AS VARCHAR) AS unique_identifier, value, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
P_SQL = "WITH p AS (SELECT l_shipdate AS time_index, 's' || l_suppkey AS unique_identifier, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey, l_linenumber FROM lineitem)"
D_SQL = P_SQL + ", d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY time_index, unique_identifier ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias(TIME), F.col("user_id").cast("string").alias(KEY), "value", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def panel_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem")
    return p.select(F.col("l_shipdate").alias(TIME), F.concat(F.lit("s"), F.col("l_suppkey")).alias(KEY), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber")


def panel_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.keep_one(panel_p(spark, sf_dir), ["l_orderkey", "l_linenumber"], colocate=(KEY,))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local session without one uses its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def untied(c: Column | str, name: str) -> Column:
    """Rounded after a shift by 1e-8, which keeps decimal ties apart from how an engine rounds them."""
    return r6((F.col(c) if isinstance(c, str) else c) + F.lit(1e-8), name)


def ntz(*ymdh: int) -> Column:
    return F.lit(datetime(*ymdh)).cast("timestamp_ntz")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user span and count of events."""
    return panel_e(spark, sf_dir).groupBy(KEY).agg(F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"), F.count("*").alias("n"))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = E_SQL + " SELECT unique_identifier, min(time_index) AS first_time, max(time_index) AS last_time, count(*) AS n FROM e GROUP BY ALL"


@query(E_SQL + " SELECT time_index, unique_identifier, value FROM e WHERE time_index >= TIMESTAMP '2024-01-05' AND time_index < TIMESTAMP '2024-01-12' AND unique_identifier IN ('1','2','3','5','8','13')")
def range_read(spark, sf_dir):
    return ranges.range_read(panel_e(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 12), less_or_equal=False, ids=["1", "2", "3", "5", "8", "13"], columns=["value"])


@query(
    E_SQL + """ SELECT time_index, unique_identifier, value FROM e WHERE
    (unique_identifier = '1' AND time_index >= TIMESTAMP '2024-01-03' AND time_index <= TIMESTAMP '2024-01-10') OR (unique_identifier = '2' AND time_index > TIMESTAMP '2024-01-20')
    OR (unique_identifier = '3' AND time_index < TIMESTAMP '2024-01-04') OR unique_identifier = '4'"""
)
def range_map_read(spark, sf_dir):
    made = {"1": ranges.Range(datetime(2024, 1, 3), datetime(2024, 1, 10)), "2": ranges.Range(datetime(2024, 1, 20), start_operand=">"), "3": ranges.Range(end=datetime(2024, 1, 4), end_operand="<"), "4": ranges.Range(), "none": ranges.Range()}
    return ranges.range_read(panel_e(spark, sf_dir), columns=["value"], ranges=made)


@query(E_SQL + " SELECT unique_identifier, min(time_index) AS min_time, grouping(unique_identifier) = 1 AS is_total FROM e GROUP BY GROUPING SETS ((), (unique_identifier))")
def time_minima(spark, sf_dir):
    return ranges.time_minima(panel_e(spark, sf_dir))


@query(D_SQL + " SELECT time_index, unique_identifier, price, volume FROM d")
def dedup_last(spark, sf_dir):
    return panel_d(spark, sf_dir).select(TIME, KEY, "price", "volume")


_HALVES = ", b AS (SELECT * FROM p WHERE l_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY time_index, unique_identifier ORDER BY l_orderkey DESC, l_linenumber DESC) = 1), i AS (SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE price END AS price) FROM p WHERE l_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY time_index, unique_identifier ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)"


def _halves(spark, sf_dir):
    """Rows of even and of odd orders, one a key; both are dealt alike, so that what follows by key shuffles nothing."""
    p = merge.dealt(panel_p(spark, sf_dir), table(spark, sf_dir, "lineitem").count())
    base = merge.keep_one(p.where("l_orderkey % 2 = 0"), ["l_orderkey", "l_linenumber"]).select(TIME, KEY, "price", "volume")
    new = merge.keep_one(p.where("l_orderkey % 2 = 1"), ["l_orderkey", "l_linenumber"])
    return base, new.select(TIME, KEY, F.when(F.col("l_linenumber") % 3 != 0, F.col("price")).alias("price"), "volume", (F.col("l_linenumber") % 5).cast("long").alias("flag"))


@query(P_SQL + _HALVES + " SELECT coalesce(i.time_index, b.time_index) AS time_index, coalesce(i.unique_identifier, b.unique_identifier) AS unique_identifier, coalesce(i.price, b.price) AS price, coalesce(i.volume, b.volume) AS volume, coalesce(CAST(i.l_linenumber % 5 AS BIGINT), -1) AS flag FROM i FULL JOIN b ON i.time_index = b.time_index AND i.unique_identifier = b.unique_identifier")
def upsert_coalesce(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return merge.upsert(base, new).select(TIME, KEY, "price", "volume", F.coalesce("flag", F.lit(-1).cast("long")).alias("flag"))


@query(P_SQL + _HALVES + " SELECT time_index, unique_identifier, price, volume, CAST(l_linenumber % 5 AS BIGINT) AS flag FROM i UNION ALL SELECT time_index, unique_identifier, price, volume, -1 FROM b ANTI JOIN i USING (time_index, unique_identifier)")
def upsert_replace(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return merge.upsert(base, new, mode="replace").select(TIME, KEY, "price", "volume", F.coalesce("flag", F.lit(-1).cast("long")).alias("flag"))


@query(P_SQL + _HALVES + " SELECT time_index, unique_identifier, price FROM i ANTI JOIN b USING (time_index, unique_identifier)")
def insert_absent(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return merge.insert_absent(base, new).select(TIME, KEY, "price")


@query(P_SQL + _HALVES + " SELECT count(*) > 0 AS overlaps FROM i SEMI JOIN b USING (time_index, unique_identifier)")
def overlap_exists(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return spark.createDataFrame([(merge.overlap_exists(base, new),)], "overlaps boolean")


@query(P_SQL + _HALVES + " SELECT coalesce(i.time_index, b.time_index) AS time_index, coalesce(i.unique_identifier, b.unique_identifier) AS unique_identifier, coalesce(i.price, b.price) AS price FROM i FULL JOIN b ON i.time_index = b.time_index AND i.unique_identifier = b.unique_identifier")
def combine_first(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return merge.combine_first(new.select(TIME, KEY, "price"), base.select(TIME, KEY, "price"))


@query(P_SQL + _HALVES + " SELECT coalesce(i.time_index, b.time_index) AS time_index, coalesce(i.unique_identifier, b.unique_identifier) AS unique_identifier, coalesce(b.volume, 0) AS base, coalesce(i.volume, 0) AS incoming FROM i FULL JOIN b ON i.time_index = b.time_index AND i.unique_identifier = b.unique_identifier")
def align_sides(spark, sf_dir):
    base, new = _halves(spark, sf_dir)
    return merge.align({"base": base, "incoming": new}, "volume", fill=0.0)


@query(
    E_SQL + """, i AS (SELECT * FROM e WHERE time_index BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND event_id % 7 = 0), s AS (SELECT unique_identifier, min(time_index) lo, max(time_index) hi FROM i GROUP BY ALL)
    SELECT time_index, unique_identifier, value FROM e ANTI JOIN s ON e.unique_identifier = s.unique_identifier AND e.time_index BETWEEN s.lo AND s.hi UNION ALL SELECT time_index, unique_identifier, -value FROM i"""
)
def replace_span(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    new = e.where(F.col(TIME).between(ntz(2024, 1, 10), ntz(2024, 1, 20)) & (F.col("event_id") % 7 == 0))
    return merge.replace_span(e.select(TIME, KEY, "value"), new.select(TIME, KEY, (-F.col("value")).alias("value")))


_STATS = ", s AS (SELECT unique_identifier, min(time_index) AS min_time, max(time_index) AS max_time FROM e WHERE time_index < TIMESTAMP '2024-01-15' AND CAST(unique_identifier AS INT) % 3 <> 0 GROUP BY ALL)"


def _stats(e: DataFrame) -> DataFrame:
    return wm.watermarks(e.where((F.col(TIME) < ntz(2024, 1, 15)) & (F.col(KEY).cast("int") % 3 != 0)))


@query(E_SQL + _STATS + " SELECT * FROM s")
def watermarks(spark, sf_dir):
    return _stats(panel_e(spark, sf_dir))


@query(E_SQL + _STATS + " SELECT e.time_index, e.unique_identifier, e.value FROM e LEFT JOIN s USING (unique_identifier) WHERE s.max_time IS NULL OR e.time_index > s.max_time")
def watermark_filter(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return wm.newer(e, _stats(e), order=["event_id"]).select(TIME, KEY, "value")


@query(E_SQL + _STATS + ", w AS (SELECT DISTINCT unique_identifier FROM e) SELECT unique_identifier, coalesce(max_time, TIMESTAMP '2023-12-31') AS max_time FROM w LEFT JOIN s USING (unique_identifier)")
def scoped_watermarks(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return wm.scoped(_stats(e), e.select(KEY).distinct(), datetime(2023, 12, 31)).withColumn("max_time", F.col("max_time").cast("timestamp_ntz"))


@query(E_SQL + _STATS + ", m AS (SELECT unique_identifier, max_time + INTERVAL 1 DAY AS lo FROM s) SELECT time_index, unique_identifier, value FROM e JOIN m USING (unique_identifier) WHERE time_index >= lo")
def read_since_watermark(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return ranges.range_read(e, columns=["value"], ranges=wm.ranges_since(_stats(e), datetime(2023, 12, 31), "1 DAY"))


@query(E_SQL + ", s AS (SELECT unique_identifier, event_type, max(time_index) AS m FROM e GROUP BY ALL) SELECT unique_identifier, min(m) AS max_time FROM s GROUP BY ALL")
def earliest_nested_watermark(spark, sf_dir):
    nested = wm.watermarks(panel_e(spark, sf_dir), (KEY, "event_type"))
    return wm.earliest(nested, datetime(2023, 12, 31)).withColumn("max_time", F.col("max_time").cast("timestamp_ntz"))


@query(E_SQL + " SELECT * EXCLUDE (k) FROM e QUALIFY row_number() OVER (PARTITION BY unique_identifier ORDER BY time_index DESC, event_id DESC) = 1")
def last_rows(spark, sf_dir):
    return wm.last_rows(panel_e(spark, sf_dir).drop("k"), tie=["event_id"])


_BARS = E_SQL + """, b AS (SELECT event_type AS unique_identifier, time_bucket(INTERVAL 1 HOUR, time_index) AS time_index, arg_min(value, (time_index, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (time_index, event_id)) AS close, CAST(sum(k) AS DOUBLE) AS volume, count(*) AS trade_count, coalesce(CASE WHEN sum(k) <> 0 THEN sum(value * k) / sum(k) END, arg_max(value, (time_index, event_id))) AS vwap FROM e GROUP BY 1, 2)"""


def _bars(spark, sf_dir, step: str = "1h") -> DataFrame:
    e = panel_e(spark, sf_dir).withColumn(KEY, F.col("event_type"))
    return bars.tick_bars(e, "value", F.col("k").cast("double"), step, tie=("event_id",))


@query(_BARS + " SELECT time_index, unique_identifier, open, high, low, close, volume, trade_count, round(vwap + 1e-8, 6) AS vwap FROM b")
def hourly_bars(spark, sf_dir):
    return _bars(spark, sf_dir).withColumn("vwap", untied("vwap", "vwap"))


@query(_BARS + """ SELECT date_trunc('day', time_index) AS time_index, unique_identifier, arg_min(open, time_index) AS open, max(high) AS high, min(low) AS low, arg_max(close, time_index) AS close, sum(volume) AS volume,
    round(coalesce(CASE WHEN sum(volume) <> 0 THEN sum(vwap * volume) / sum(volume) END, arg_max(close, time_index)) + 1e-8, 6) AS vwap, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM b GROUP BY 1, 2""")
def daily_bars(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return bars.fold(b, [KEY, F.date_trunc("day", TIME).cast("timestamp_ntz").alias("day")]).withColumnRenamed("day", TIME).withColumn("vwap", untied("vwap", "vwap"))


@query(_BARS + """ SELECT time_index, unique_identifier, first_value(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close, sum(volume) OVER w AS volume,
    round(coalesce(CASE WHEN sum(volume) OVER w <> 0 THEN sum(vwap * volume) OVER w / sum(volume) OVER w END, close) + 1e-8, 6) AS vwap, epoch_us(first_value(time_index) OVER w - INTERVAL 1 HOUR) * 1000 AS open_time
    FROM b WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 4""")
def sliding_bars(spark, sf_dir):
    s = bars.upsample(_bars(spark, sf_dir), "1h", "4h")
    return s.select(TIME, KEY, "open", "high", "low", "close", "volume", untied("vwap", "vwap"), "open_time")


@query("WITH h AS (SELECT n FROM (SELECT length(CAST(epoch_ms(ts) AS VARCHAR)) AS n, count(*) AS c FROM events GROUP BY ALL) ORDER BY c DESC, n LIMIT 1) SELECT CASE WHEN n >= 18 THEN 'ns' WHEN n >= 15 THEN 'us' WHEN n >= 12 THEN 'ms' WHEN n >= 10 THEN 's' ELSE 'min' END AS unit FROM h")
def epoch_unit(spark, sf_dir):
    e = panel_e(spark, sf_dir).select(F.unix_millis(F.col(TIME).cast("timestamp")).alias("at"))
    return bars.infer_unit(e, "at")


_DAILY = P_SQL + ", m AS (SELECT time_index, unique_identifier, avg(price) AS price, sum(volume) AS volume FROM p GROUP BY ALL)"


def _daily(spark, sf_dir) -> DataFrame:
    p = panel_p(spark, sf_dir)
    return p.groupBy(TIME, KEY).agg(F.avg("price").alias("price"), F.sum("volume").alias("volume"))


_DENSE = _DAILY + ", g AS (SELECT a.time_index, b.unique_identifier, m.price, m.volume FROM (SELECT DISTINCT time_index FROM m) a CROSS JOIN (SELECT DISTINCT unique_identifier FROM m) b LEFT JOIN m USING (time_index, unique_identifier)), f AS (SELECT time_index, unique_identifier, price AS raw, last_value(price IGNORE NULLS) OVER w AS price, volume FROM g WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS UNBOUNDED PRECEDING))"


def _dense(spark, sf_dir) -> DataFrame:
    m = _daily(spark, sf_dir)
    return fill.dense(m, m, m)


@query(_DENSE + ", x AS (SELECT *, first_value(price IGNORE NULLS) OVER (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM f) SELECT time_index, unique_identifier, round(price + 1e-8, 6) AS forward, round(back + 1e-8, 6) AS both FROM x")
def dense_fill(spark, sf_dir):
    m = _daily(spark, sf_dir)
    f = fill.dense_ffill(m, m, m, ["price"], ["price"])
    return f.select(TIME, KEY, untied("price", "forward"), untied("price_ahead", "both"))


_GRID = " , g AS (SELECT u.unique_identifier, t.time_index FROM (SELECT DISTINCT unique_identifier FROM e) u CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 12 HOUR)) AS time_index) t)"


def _grid(spark, e: DataFrame) -> DataFrame:
    times = spark.range(1).select(F.explode(F.sequence(ntz(2024, 1, 2), ntz(2024, 1, 29), F.expr("INTERVAL 12 HOURS"))).alias(TIME))
    return e.select(KEY).distinct().crossJoin(F.broadcast(times))


@query(E_SQL + _GRID + " SELECT g.time_index, g.unique_identifier, e.value, e.time_index AS set_at FROM g ASOF LEFT JOIN e ON g.unique_identifier = e.unique_identifier AND g.time_index >= e.time_index")
def asof_grid(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return fill.asof(_grid(spark, e), e, ["value"], source_time="set_at").select(TIME, KEY, "value", "set_at")


@query(E_SQL + _GRID + " SELECT g.time_index, g.unique_identifier, CASE WHEN g.time_index < e.time_index + INTERVAL 6 HOUR THEN e.value END AS value FROM g ASOF LEFT JOIN e ON g.unique_identifier = e.unique_identifier AND g.time_index >= e.time_index")
def asof_tolerance(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return fill.asof(_grid(spark, e), e, ["value"], tolerance="6 HOURS").select(TIME, KEY, "value")


@query(E_SQL + """, s AS (SELECT unique_identifier, time_bucket(INTERVAL 1 DAY, time_index) AS t, arg_max(value, (time_index, event_id)) AS value FROM e GROUP BY ALL), b AS (SELECT unique_identifier, min(t) lo, max(t) hi FROM s GROUP BY ALL),
    g AS (SELECT unique_identifier, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t FROM b) SELECT g.t AS time_index, g.unique_identifier, last_value(value IGNORE NULLS) OVER (PARTITION BY g.unique_identifier ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN s USING (unique_identifier, t)""")
def resample_daily(spark, sf_dir):
    e = merge.keep_one(panel_e(spark, sf_dir), ["event_id"])
    return fill.resample_last(e, "1 DAY", ["value"]).select(TIME, KEY, "value")


_W = " WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index)"


@query(
    D_SQL + """ SELECT time_index, unique_identifier, round(coalesce(price / lag(price) OVER w - 1, 0), 6) AS ret, round(lead(price) OVER w / price - 1, 6) AS next_ret, round(ln(price) - ln(lag(price) OVER w), 6) AS log_ret,
    round(price / first_value(price) OVER w * 100, 4) AS rebased FROM d""" + _W
)
def returns(spark, sf_dir):
    p = F.col("price")
    return panel_d(spark, sf_dir).select(TIME, KEY, r6(rolling.simple_return(p), "ret"), r6(rolling.next_return(p), "next_ret"), r6(rolling.log_return(p), "log_ret"), r6(rolling.rebased(p), "rebased", 4))


@query(_DENSE + ", q AS (SELECT *, lag(price) OVER w AS prev FROM f" + _W + ") SELECT time_index, unique_identifier, round(price / prev - 1, 6) AS ret FROM q")
def padded_returns(spark, sf_dir):
    return _dense(spark, sf_dir).select(TIME, KEY, r6(rolling.padded_return(F.col("price")), "ret"))


@query(E_SQL + " SELECT time_index, unique_identifier, round(100 * product(1 + value / 10000) OVER w, 4) AS nav FROM e WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index, event_id ROWS UNBOUNDED PRECEDING)")
def nav(spark, sf_dir):
    w = Window.partitionBy(KEY).orderBy(TIME, "event_id")
    return panel_e(spark, sf_dir).select(TIME, KEY, r6(rolling.nav(F.col("value") / 10000, 100.0, w), "nav", 4))


@query(
    D_SQL + """ SELECT time_index, unique_identifier, round(median(price) OVER a + 1e-8, 6) AS med, CASE WHEN count(price) OVER a = 20 THEN round(stddev_samp(price) OVER a, 6) END AS sd, round(avg(CASE WHEN volume > 25 THEN 1.0 ELSE 0.0 END) OVER a, 6) AS freq,
    CASE WHEN count(price) OVER b = 5 THEN round(avg(price) OVER b, 6) END AS sma FROM d WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def rolling_stats(spark, sf_dir):
    p = F.col("price")
    freq = rolling.rolling_mean(F.when(F.col("volume") > 25, 1.0).otherwise(0.0), 20)
    d = passes.rolling_medians(panel_d(spark, sf_dir), {"med": (p, 20)})
    return d.select(TIME, KEY, untied("med", "med"), r6(rolling.rolling_std(p, 20), "sd"), r6(freq, "freq"), r6(rolling.sma(p, 5), "sma"))


@query(
    D_SQL + """, l AS (SELECT time_index, unique_identifier, price, list(price) OVER (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 344 PRECEDING AND CURRENT ROW) AS x FROM d),
    q AS (SELECT *, len(x) AS n, list_transform(generate_series(1, len(x)), lambda i: CASE WHEN i = 1 THEN power(1 - 2.0 / 21, len(x) - 1) ELSE 2.0 / 21 * power(1 - 2.0 / 21, len(x) - i) END) AS w FROM l)
    SELECT time_index, unique_identifier, CASE WHEN n > 1 THEN round(sqrt(greatest(0, (list_sum(list_transform(list_zip(w, x), lambda z: z[1] * z[2] * z[2])) - power(list_sum(list_transform(list_zip(w, x), lambda z: z[1] * z[2])), 2)) / (1 - list_sum(list_transform(w, lambda v: v * v))))), 4) END AS sd FROM q"""
)
def ewm_std(spark, sf_dir):
    d = passes.exponential(panel_d(spark, sf_dir).select(TIME, KEY, "price"), {"sd": ("std", F.col("price"), 20)})
    return d.select(TIME, KEY, r6("sd", "sd", 4))


@query(D_SQL + ", r AS (SELECT time_index, unique_identifier, volume, rank() OVER (PARTITION BY time_index ORDER BY volume DESC) + (count(*) OVER (PARTITION BY time_index, volume) - 1) / 2.0 AS rk FROM d) SELECT time_index, unique_identifier, CAST(rk AS DOUBLE) AS rk, CASE WHEN rk <= 5 THEN volume ELSE 0 END AS kept FROM r")
def topn_average_rank(spark, sf_dir):
    d = panel_d(spark, sf_dir).withColumn("rk", rolling.average_rank(F.col("volume")).cast("double"))
    return d.select(TIME, KEY, "rk", F.when(F.col("rk") <= 5, F.col("volume")).otherwise(0.0).alias("kept"))


_MCAP = P_SQL + """, h AS (SELECT time_index, unique_identifier, avg(price * 50) AS market_cap, avg(price) AS price, avg(volume) AS volume FROM p GROUP BY ALL),
    g AS (SELECT a.time_index, b.unique_identifier, h.* EXCLUDE (time_index, unique_identifier) FROM (SELECT DISTINCT time_index FROM h) a CROSS JOIN (SELECT DISTINCT unique_identifier FROM h) b LEFT JOIN h USING (time_index, unique_identifier)),
    f AS (SELECT time_index, unique_identifier, last_value(market_cap IGNORE NULLS) OVER w AS market_cap, last_value(price IGNORE NULLS) OVER w AS price, last_value(volume IGNORE NULLS) OVER w AS volume FROM g WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT time_index, unique_identifier, first_value(market_cap IGNORE NULLS) OVER w AS market_cap, first_value(price IGNORE NULLS) OVER w AS price, first_value(volume IGNORE NULLS) OVER w AS volume FROM f WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    l AS (SELECT *, median(price * volume) OVER a * 252 / market_cap AS a20, median(price * volume) OVER z * 252 / market_cap AS a60, avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END) OVER z AS fr FROM b WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), z AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, rank() OVER (PARTITION BY time_index ORDER BY market_cap DESC) + (count(*) OVER (PARTITION BY time_index, market_cap) - 1) / 2.0 AS rk FROM l),
    c AS (SELECT *, CASE WHEN a20 >= 120 AND a60 >= 120 AND fr >= 0.9 AND rk <= 20 THEN market_cap ELSE 0 END AS cap FROM r),
    k AS (SELECT time_index, unique_identifier, price, volume, coalesce(CASE WHEN sum(cap) OVER (PARTITION BY time_index) <> 0 THEN cap / sum(cap) OVER (PARTITION BY time_index) END, 0) AS signal_weight FROM c)"""


def _mcap(spark, sf_dir):
    p = panel_p(spark, sf_dir).withColumn("market_cap", F.col("price") * 50)
    return p.select(TIME, KEY, "market_cap", "price", "volume")


@query(_MCAP + " SELECT time_index, unique_identifier, round(signal_weight, 6) AS signal_weight FROM k")
def marketcap_weights(spark, sf_dir):
    w = signals.market_cap_weights(_mcap(spark, sf_dir), 20, (20, 60), 120.0)
    return w.select(TIME, KEY, r6("signal_weight", "signal_weight"))


@query(
    _MCAP + """, m AS (SELECT time_index, unique_identifier, avg(price) AS close, avg(volume) AS volume FROM p GROUP BY ALL),
    q AS (SELECT k.time_index, k.unique_identifier, k.signal_weight AS cur, coalesce(lag(k.signal_weight) OVER w, 0) AS bef, last_value(m.close IGNORE NULLS) OVER w AS close FROM k LEFT JOIN m USING (time_index, unique_identifier) WINDOW w AS (PARTITION BY k.unique_identifier ORDER BY k.time_index)),
    s AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM q""" + _W + """),
    t AS (SELECT time_index, sum(bef * r) - sum(abs(cur - bef)) * 0.001 AS ret FROM s GROUP BY ALL HAVING count(*) = count(close))
    SELECT time_index, round(ret, 6) AS ret, round(product(1 + ret) OVER (ORDER BY time_index ROWS UNBOUNDED PRECEDING), 6) AS nav FROM t"""
)
def portfolio_returns(spark, sf_dir):
    h = _mcap(spark, sf_dir)
    # the weights' panel has the prices of every time that the portfolio trades at
    w = signals.market_cap_weights(h, 20, (20, 60), 120.0, keep=True)
    frame = w.select(TIME, KEY, F.col("signal_weight").alias("weights"), "price", "volume")
    r = portfolio.portfolio_returns(portfolio.immediate(frame), None, 0.001)
    return portfolio.portfolio_values(r).select(TIME, r6("return", "ret"), r6("close", "nav"))


@query(
    D_SQL + """, o AS (SELECT time_index, unique_identifier, count(*) OVER w AS n, regr_slope(price, volume) OVER w AS b, regr_intercept(price, volume) OVER w AS a, regr_r2(price, volume) OVER w AS r2, regr_sxx(price, volume) OVER w AS sxx, regr_syy(price, volume) OVER w AS syy FROM d WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT time_index, unique_identifier, CASE WHEN n = 30 THEN round(b, 4) END AS beta, CASE WHEN n = 30 THEN round(a, 4) END AS intercept, CASE WHEN n = 30 THEN round(r2, 5) END AS r2, CASE WHEN n = 30 THEN round(b / sqrt((syy - b * b * sxx) / 29 / sxx), 4) END AS t_beta FROM o"""
)
def rolling_ols(spark, sf_dir):
    made = rolling.rolling_ols(panel_d(spark, sf_dir), "price", "volume", 30)
    return made.select(TIME, KEY, r6("beta", "beta", 4), r6("intercept", "intercept", 4), r6("r_squared", "r2", 5), r6("t_beta", "t_beta", 4))


@query(_DAILY + " SELECT time_index, unique_identifier, round(price + 1e-8, 6) AS price FROM m")
def map_round_trip(spark, sf_dir):
    m = _daily(spark, sf_dir).select(TIME, KEY, untied("price", "price"))
    return reshape.from_map(reshape.to_map(m, "price", as_json=True), "price", "price", is_json=True).select(TIME, KEY, r6("price", "price"))


_FLAGS = "WITH m AS (SELECT l_shipdate AS time_index, l_returnflag AS name, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL)"


def _by_flag(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return reshape.to_wide(l.select(F.col("l_shipdate").alias(TIME), F.col("l_returnflag").alias(KEY), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")), "price", ["A", "N", "R"])


@query(_FLAGS + """ SELECT time_index, round(max(price) FILTER (name = 'A'), 6) AS "A", round(max(price) FILTER (name = 'N'), 6) AS "N", round(max(price) FILTER (name = 'R'), 6) AS "R" FROM m GROUP BY ALL""")
def wide_pivot(spark, sf_dir):
    return _by_flag(spark, sf_dir).select(TIME, r6("A", "A"), r6("N", "N"), r6("R", "R"))


@query(_FLAGS + " SELECT time_index, name, round(price, 6) AS price FROM m")
def wide_unpivot(spark, sf_dir):
    return reshape.to_long(_by_flag(spark, sf_dir), ["A", "N", "R"], "price", "name").select(TIME, "name", r6("price", "price"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, 'l_quantity' AS a, 'l_extendedprice' AS b FROM lineitem UNION ALL SELECT round(corr(l_quantity, l_discount), 6), 'l_quantity', 'l_discount' FROM lineitem UNION ALL SELECT round(corr(l_extendedprice, l_discount), 6), 'l_extendedprice', 'l_discount' FROM lineitem")
def metric_corr(spark, sf_dir):
    c = reshape.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return c.where(F.col("left") != F.col("right")).select(r6("corr", "c"), F.col("left").alias("a"), F.col("right").alias("b"))


@query("SELECT min(q) AS quarter FROM (SELECT l_suppkey, max(year(l_shipdate) * 4 + quarter(l_shipdate)) AS q FROM lineitem GROUP BY ALL)")
def latest_common_quarter(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(KEY), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("long").alias("quarter"))
    return reshape.latest_common(l)


@query(E_SQL + " SELECT CAST(CAST(time_index AS DATE) AS VARCHAR) AS day, event_type, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY CAST(time_index AS DATE), event_type ORDER BY time_index, event_id) <= 2")
def head_per_day(spark, sf_dir):
    e = panel_e(spark, sf_dir).withColumn("day", F.to_date(TIME))
    return reshape.head_n(e, 2, ["day", "event_type"], [TIME, "event_id"]).select(F.col("day").cast("string").alias("day"), "event_type", "event_id", "value")


@query(E_SQL + " SELECT CAST(CAST(time_index AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM e GROUP BY ALL")
def label_counts(spark, sf_dir):
    e = panel_e(spark, sf_dir).groupBy(F.to_date(TIME).cast("string").alias("day")).pivot("event_type", ["click", "view", "error"]).count()
    return e.fillna(0)


@query(E_SQL + " SELECT time_bucket(INTERVAL 1 HOUR, time_index) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM e GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    return live.tumbling(panel_e(spark, sf_dir), "1 hour", "value", ["event_type"]).withColumn("total", r6("total", "total", 4))


@query(
    E_SQL + """, g AS (SELECT *, CASE WHEN time_index - lag(time_index) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index)), s AS (SELECT *, sum(brk) OVER (PARTITION BY unique_identifier ORDER BY time_index) AS sid FROM g)
    SELECT unique_identifier, min(time_index) AS session_start, max(time_index) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY unique_identifier, sid"""
)
def session_events(spark, sf_dir):
    return live.sessions(panel_e(spark, sf_dir), "2 hours")


@query(
    """WITH h AS (SELECT o_custkey AS asset_id, count(*)::DOUBLE AS holding, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), x AS (SELECT o_custkey AS asset_id, count(*)::DOUBLE AS expected FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
    b AS (SELECT coalesce(h.asset_id, x.asset_id) AS asset_id, coalesce(holding, 0) AS holding, coalesce(expected, 0) AS expected, price FROM h FULL JOIN x ON h.asset_id = x.asset_id)
    SELECT asset_id, holding, expected, expected - holding AS difference, round((expected - holding) * price / 1000000, 6) AS relative, CASE WHEN abs((expected - holding) * price / 1000000) >= 0.25 THEN expected - holding ELSE 0 END AS trade FROM b"""
)
def account_rebalance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("asset_id"), F.lit(1.0).alias("quantity"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("order_time"))
    r = portfolio.account_rebalance(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), 1e6, 0.25)
    return r.select("asset_id", "holding", "expected", "difference", r6("relative", "relative"), "trade")


_FLOWS = "WITH c AS (SELECT l_suppkey AS ins_id, CAST(l_shipdate AS DATE) AS payment_date, l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN 'fixed' ELSE 'floating' END AS leg FROM lineitem), p AS (SELECT s_suppkey AS ins_id, CAST(s_suppkey % 7 AS DOUBLE) - 3 AS units FROM supplier), f AS (SELECT c.*, units FROM c JOIN p USING (ins_id))"


def _flows(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ins_id"), F.to_date("l_shipdate").alias("payment_date"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_returnflag") == "R", "fixed").otherwise("floating").alias("leg"))
    return c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ins_id"), ((F.col("s_suppkey") % 7).cast("double") - 3).alias("units"))


@query(_FLOWS + " SELECT CAST(payment_date AS VARCHAR) AS payment_date, round(sum(amount * units), 2) AS amount FROM f GROUP BY ALL")
def net_cashflows(spark, sf_dir):
    return position.net_cashflows(*_flows(spark, sf_dir)).select(F.col("payment_date").cast("string").alias("payment_date"), r6("amount", "amount", 2))


@query(_FLOWS + " SELECT leg, CAST(payment_date AS VARCHAR) AS payment_date, round(sum(amount * units), 2) AS amount FROM f GROUP BY ALL")
def cashflows_by_leg(spark, sf_dir):
    return position.cashflows_by_leg(*_flows(spark, sf_dir), F.lit("1995-01-01").cast("date")).select("leg", F.col("payment_date").cast("string").alias("payment_date"), r6("amount", "amount", 2))


@query(_FLOWS + " SELECT round(coalesce(sum(amount * units) FILTER (payment_date > DATE '1996-01-01' AND payment_date <= DATE '1996-07-01'), 0), 2) AS carry FROM f")
def position_carry(spark, sf_dir):
    c, p = _flows(spark, sf_dir)
    return position.carry(c, p, F.lit("1996-01-01").cast("date"), F.lit("1996-07-01").cast("date")).select(r6("carry", "carry", 2))


@query("WITH b AS (SELECT l_suppkey AS ins_id, sum(l_extendedprice) AS b, sum(l_extendedprice * (1 - l_discount)) AS u FROM lineitem GROUP BY ALL), r AS (SELECT CAST(ins_id AS VARCHAR) AS ins_id, b * (ins_id % 7 - 3) AS base, u * (ins_id % 7 - 3) AS bumped FROM b) SELECT coalesce(ins_id, 'TOTAL') AS ins_id, round(sum(base), 2) AS base, round(sum(bumped), 2) AS bumped, round(sum(bumped) - sum(base), 2) AS delta FROM r GROUP BY ROLLUP (ins_id)")
def npv_table(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("ins_id", F.col("l_suppkey").cast("string"))
    _, p = _flows(spark, sf_dir)
    base = l.groupBy("ins_id").agg(F.sum("l_extendedprice").alias("npv"))
    up = l.groupBy("ins_id").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("npv"))
    t = position.npv_table(base, up, p.withColumn("ins_id", F.col("ins_id").cast("string")))
    return t.select("ins_id", r6("base", "base", 2), r6("bumped", "bumped", 2), r6("delta", "delta", 2))


@query(
    """WITH n(days, zero) AS (VALUES (30, 0.05), (90, 0.052), (365, 5.5), (1825, 0.06)), c AS (SELECT days::DOUBLE AS days, ln(1 / (1 + CASE WHEN zero > 1 THEN zero / 100 ELSE zero END * days / 360.0)) AS l FROM n UNION ALL SELECT 0, 0), s AS (SELECT days AS d0, l AS l0, lead(days) OVER (ORDER BY days) AS d1, lead(l) OVER (ORDER BY days) AS l1 FROM c),
    x AS (SELECT DISTINCT date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem)
    SELECT CAST(x.days AS BIGINT) AS days, round(exp(l0 + (l1 - l0) / (d1 - d0) * (x.days - d0)), 8) AS df FROM x JOIN s ON d1 IS NOT NULL AND ((x.days >= d0 AND x.days < d1) OR (x.days >= d1 AND d1 = 1825))"""
)
def discount_curve(spark, sf_dir):
    nodes = spark.createDataFrame([("c", 30, 0.05), ("c", 90, 0.052), ("c", 365, 5.5), ("c", 1825, 0.06), ("c", -1, 0.9)], "curve_id string, days int, zero double")
    days = table(spark, sf_dir, "lineitem").select(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.lit("c").alias("curve_id")).distinct()
    return curves.discounted(days, nodes).select("days", r6("df", "df", 8))


@query(
    D_SQL + """, n AS (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT d.time_index, 'g' || substr(d.unique_identifier, 2) AS unique_identifier, CASE WHEN n_regionkey <= 1 THEN d.price ELSE -d.price END AS price FROM d JOIN n ON d.unique_identifier = 's' || n.s_suppkey"""
)
def translated_read(spark, sf_dir):
    d = panel_d(spark, sf_dir).select(TIME, KEY, "price")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entities = s.select(F.concat(F.lit("g"), F.col("s_suppkey")).alias(KEY), F.col("s_suppkey").alias("group_id"), "n_regionkey")
    assets = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias(KEY), F.col("s_suppkey").alias("group_id"), F.lit("x").alias("exchange"))
    read = {"plain": d, "negated": d.withColumn("price", -F.col("price"))}
    rules = [Rule(F.col("n_regionkey") <= 1, "plain", "x"), Rule(F.lit(True), "negated", "x")]
    return wrapped_read(read.__getitem__, entities, assets, rules).select(TIME, KEY, "price")


@query(D_SQL + ", k AS (SELECT unique_identifier FROM d GROUP BY ALL HAVING max(volume) > 49.5) SELECT unique_identifier, count(*) AS n FROM d SEMI JOIN k USING (unique_identifier) GROUP BY ALL")
def ever_above(spark, sf_dir):
    return ranges.ever_above(panel_d(spark, sf_dir), "volume", 49.5).groupBy(KEY).agg(F.count("*").alias("n"))


@query(
    _BARS + """, w AS (SELECT unique_identifier, min(time_index) lo, max(time_index) hi FROM b GROUP BY ALL), days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) + INTERVAL 1439 MINUTE AS time_index),
    g AS (SELECT days.time_index, w.unique_identifier FROM w JOIN days ON days.time_index BETWEEN date_trunc('day', lo) AND hi), a AS (SELECT DISTINCT time_index, unique_identifier FROM (SELECT * FROM g UNION ALL SELECT time_index, unique_identifier FROM b)),
    f AS (SELECT a.*, b.open, b.volume, last_value(b.close IGNORE NULLS) OVER z AS c1, b.close FROM a LEFT JOIN b USING (time_index, unique_identifier) WINDOW z AS (PARTITION BY a.unique_identifier ORDER BY a.time_index ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT *, coalesce(c1, first_value(c1 IGNORE NULLS) OVER (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c2 FROM f)
    SELECT h.time_index, h.unique_identifier, h.c2 AS close, CASE WHEN h.close IS NULL THEN c2 ELSE h.open END AS open, CASE WHEN h.close IS NULL THEN 0 ELSE h.volume END AS volume, h.close IS NULL AS interpolated FROM h SEMI JOIN g USING (time_index, unique_identifier)"""
)
def daily_gap_fill(spark, sf_dir):
    b = _bars(spark, sf_dir)
    days = spark.range(1).select(F.explode(F.sequence(ntz(2024, 1, 1), ntz(2024, 1, 30), F.expr("INTERVAL 1 DAY"))).alias("market_open"))
    schedule = days.select(F.to_date("market_open").alias("session"), "market_open", (F.col("market_open") + F.expr("INTERVAL 1439 MINUTES")).alias("market_close"))
    return bars.fill_daily(b, schedule).select(TIME, KEY, "close", "open", "volume", "interpolated")


@query(_DENSE + " SELECT time_index, unique_identifier, round(price + 1e-8, 6) AS price, round(price / first_value(price) OVER w * 100, 4) AS rebased FROM f" + _W)
def common_report(spark, sf_dir):
    r = portfolio.common_report(_daily(spark, sf_dir), value="price")
    return r.select(TIME, KEY, untied("price", "price"), r6("rebased", "rebased", 4))


@query(
    D_SQL + """, w AS (SELECT * FROM d),
    t AS (SELECT DISTINCT time_index AS set_at FROM w), g AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2001-12-10', INTERVAL 1 DAY)) AS time_index),
    a AS (SELECT g.time_index, t.set_at FROM g ASOF JOIN t ON g.time_index >= t.set_at WHERE g.time_index < t.set_at + INTERVAL 10 DAY)
    SELECT a.time_index, n.unique_identifier, coalesce(w.volume, 0) AS signal_weight FROM a CROSS JOIN (SELECT DISTINCT unique_identifier FROM w) n LEFT JOIN w ON w.time_index = a.set_at AND w.unique_identifier = n.unique_identifier"""
)
def weights_on_grid(spark, sf_dir):
    d = panel_d(spark, sf_dir)
    grid = spark.range(1).select(F.explode(F.sequence(ntz(1995, 1, 2), ntz(2001, 12, 10), F.expr("INTERVAL 1 DAY"))).alias(TIME))
    return signals.weights_on_grid(d.withColumnRenamed("volume", "signal_weight"), grid, "10 DAYS")


@query(
    _BARS + """, y AS (SELECT unique_identifier, CAST(time_index AS DATE) AS day, arg_max(close, time_index) / arg_min(open, time_index) - 1 AS ret, count(*) AS n FROM b GROUP BY ALL),
    z AS (SELECT *, CAST(sign(lag(ret) OVER (PARTITION BY unique_identifier ORDER BY day)) AS DOUBLE) AS dir FROM y), q AS (SELECT b.*, dir, n, lead(b.time_index) OVER w IS NULL AS last, sum(CASE WHEN sign(b.close - b.open) = dir THEN 1 ELSE 0 END) OVER w AS hits FROM b JOIN z ON b.unique_identifier = z.unique_identifier AND CAST(b.time_index AS DATE) = z.day WINDOW w AS (PARTITION BY b.unique_identifier, z.day ORDER BY b.time_index))
    SELECT time_index, unique_identifier, round(CASE WHEN last THEN 0 ELSE coalesce(dir * hits / n, 0) END, 6) AS signal_weight FROM q"""
)
def intraday_trend(spark, sf_dir):
    return signals.intraday_trend_weights(_bars(spark, sf_dir)).withColumn("signal_weight", r6("signal_weight", "signal_weight"))


@query(
    D_SQL + """, c AS (SELECT time_index, unique_identifier, price, price - lag(price) OVER w AS ch FROM d""" + _W + """), q AS (SELECT time_index, unique_identifier, count(price) OVER a AS n, avg(price) OVER a AS sma, count(ch) OVER a AS m, avg(greatest(ch, 0)) OVER a AS up, avg(greatest(-ch, 0)) OVER a AS down FROM c WHERE true WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT time_index, unique_identifier, CASE WHEN n = 14 THEN round(sma, 5) END AS sma, CASE WHEN m = 14 THEN round(CASE WHEN up + down > 0 THEN 100 * up / (up + down) ELSE 50 END, 5) END AS rsi FROM q"""
)
def indicators(spark, sf_dir):
    from .functions.scalar import feature_name

    sma, rsi = {"name": "SMA", "length": 14}, {"name": "RSI", "length": 14}
    out = rolling.indicators(panel_d(spark, sf_dir), [sma, rsi], price="price")
    return out.select(TIME, KEY, r6(feature_name(sma), "sma", 5), r6(feature_name(rsi), "rsi", 5))


@query(E_SQL + " SELECT unique_identifier, 'value' AS column_name, max(time_index) FILTER (value > 20) AS max_time FROM e GROUP BY ALL UNION ALL SELECT unique_identifier, 'k', max(time_index) FILTER (k > 20) FROM e GROUP BY ALL")
def column_watermarks(spark, sf_dir):
    e = panel_e(spark, sf_dir).select(TIME, KEY, F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("k") > 20, F.col("k")).alias("k"))
    return wm.column_watermarks(e, ["value", "k"])


@query(E_SQL + _STATS + " SELECT unique_identifier, CASE WHEN NOT (TIMESTAMP '2024-01-15' - max_time < INTERVAL 1 DAY) THEN max_time + INTERVAL 5 MILLISECOND END AS next_query FROM s")
def next_query(spark, sf_dir):
    return wm.next_query(_stats(panel_e(spark, sf_dir)), datetime(2024, 1, 15), "1 DAY").select(KEY, F.col("next_query").cast("timestamp_ntz").alias("next_query"))


@query(E_SQL + _STATS.replace("SELECT unique_identifier, min", "SELECT unique_identifier, event_type, min") + ", w AS (SELECT u.unique_identifier, t.event_type FROM (SELECT DISTINCT unique_identifier FROM e) u, (SELECT DISTINCT event_type FROM e WHERE event_type <> 'view') t) SELECT w.unique_identifier, w.event_type, coalesce(max_time, TIMESTAMP '2023-12-31') AS max_time FROM w LEFT JOIN s USING (unique_identifier, event_type)")
def pruned_watermarks(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    nested = wm.watermarks(e.where((F.col(TIME) < ntz(2024, 1, 15)) & (F.col(KEY).cast("int") % 3 != 0)), (KEY, "event_type"))
    types = spark.createDataFrame([(t,) for t in ("signup", "purchase", "error", "click")], "event_type string")
    wanted = e.select(KEY).distinct().crossJoin(F.broadcast(types))
    return wm.pruned(nested, wanted, datetime(2023, 12, 31)).withColumn("max_time", F.col("max_time").cast("timestamp_ntz"))


@query(
    _DENSE + """, t AS (SELECT m.time_index, m.unique_identifier, price AS new, coalesce(lag(price) OVER w, 0) AS old FROM m""" + _W + """)
    SELECT a.time_index, a.unique_identifier, round(t.old + (t.new - t.old) * least(1, date_diff('second', t.time_index, a.time_index) / 432000.0) + 1e-8, 6) AS weights FROM g a ASOF LEFT JOIN t ON a.unique_identifier = t.unique_identifier AND a.time_index >= t.time_index"""
)
def time_weighted(spark, sf_dir):
    targets = _daily(spark, sf_dir).withColumnRenamed("price", "weights")
    out = portfolio.time_weighted(_dense(spark, sf_dir), targets, "5d")
    return out.select(TIME, KEY, untied("weights", "weights"))


@query(
    _DENSE + """, o AS (SELECT time_index, avg(price) AS own FROM m GROUP BY ALL), s AS (SELECT time_index, price FROM m WHERE unique_identifier = 's3'), j AS (SELECT o.time_index, own, s.price FROM o ASOF LEFT JOIN s ON o.time_index >= s.time_index),
    b AS (SELECT time_index, own, first_value(price IGNORE NULLS) OVER (ORDER BY time_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM j)
    SELECT time_index, round(own, 6) AS calculated_close, close, round(coalesce(close / lag(close) OVER (ORDER BY time_index) - 1, 0), 6) AS ret FROM b"""
)
def override_close(spark, sf_dir):
    m = _daily(spark, sf_dir)
    own = m.groupBy(TIME).agg(F.avg("price").alias("close"))
    out = portfolio.override_close(own, m, "s3", "price")
    return out.select(TIME, r6("calculated_close", "calculated_close"), "close", r6("return", "ret"))


@query(_DAILY + ", k AS (SELECT time_index, row_number() OVER (ORDER BY time_index) % 2 AS odd FROM (SELECT DISTINCT time_index FROM m)) SELECT time_index, n AS unique_identifier, CASE WHEN odd = 1 THEN w ELSE -w END AS signal_weight FROM k, (VALUES ('a', 0.25::DOUBLE), ('b', 0.75::DOUBLE)) x(n, w)")
def alternating_signal(spark, sf_dir):
    return signals.alternating(_daily(spark, sf_dir).select(TIME).distinct(), {"a": 0.25, "b": 0.75})


@query("WITH b AS (SELECT s_suppkey AS ins_id, 100.0 * (1 + s_suppkey % 5) AS face, 0.01 * (s_suppkey % 4) AS coupon, DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS a, DATE '2025-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS z FROM supplier), q AS (SELECT *, unnest(generate_series(0, 3)) AS i FROM b), d AS (SELECT ins_id, face, coupon, i, CAST(a + INTERVAL 3 MONTH * i AS DATE) AS s0, CAST(a + INTERVAL 3 MONTH * (i + 1) AS DATE) AS s1, z FROM q), j AS (SELECT *, s0 + CAST(CASE isodow(s0) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS p0, s1 + CAST(CASE isodow(s1) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS p1 FROM d) SELECT ins_id, 'coupon' AS leg, CAST(p1 AS VARCHAR) AS payment_date, round(face * coupon * date_diff('day', p0, p1) / 360, 8) AS amount FROM j WHERE coupon <> 0 UNION ALL SELECT ins_id, 'redemption', CAST(p1 AS VARCHAR), face FROM j WHERE i = 3")
def bond_cashflows(spark, sf_dir):
    from .instruments import pricing

    k = F.col("s_suppkey")
    shift = (k % 20).cast("int")
    b = table(spark, sf_dir, "supplier").select(k.alias("ins_id"), (100.0 * (1 + k % 5)).alias("face"), (0.01 * (k % 4)).alias("coupon"), F.date_add(F.lit("2024-01-01").cast("date"), shift).alias("start_date"), F.date_add(F.lit("2025-01-01").cast("date"), shift).alias("end_date"), F.lit(3).alias("months"))
    return pricing.bond_cashflows(b).select("ins_id", "leg", F.col("payment_date").cast("string").alias("payment_date"), r6("amount", "amount", 8))


@query(P_SQL + _HALVES + " SELECT coalesce(i.time_index, b.time_index) AS time_index, coalesce(i.unique_identifier, b.unique_identifier) AS unique_identifier, coalesce(i.price, b.price) AS price, coalesce(i.volume, b.volume) AS volume FROM i FULL JOIN b ON i.time_index = b.time_index AND i.unique_identifier = b.unique_identifier")
def stored_upsert(spark, sf_dir):
    """Two upserts into a stored table, read back; written to the shared folder."""
    import uuid

    from .sources.store import PanelStore

    store = PanelStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    base, new = _halves(spark, sf_dir)
    store.upsert(base, "prices")
    store.upsert(new.drop("flag"), "prices")
    return store.scan("prices").select(TIME, KEY, "price", "volume")


@query(_BARS + " SELECT day, click, view, error FROM (SELECT CAST(CAST(time_index AS DATE) AS VARCHAR) AS day, sum(trade_count) FILTER (unique_identifier = 'click')::BIGINT AS click, sum(trade_count) FILTER (unique_identifier = 'view')::BIGINT AS view, sum(trade_count) FILTER (unique_identifier = 'error')::BIGINT AS error FROM b GROUP BY ALL)")
def node_graph(spark, sf_dir):
    """Two nodes, hourly bars and daily counts made from them, updated through the runner into a store."""
    import uuid

    from .plans.node import FunctionNode, run
    from .sources.store import PanelStore

    store = PanelStore(spark, f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}")
    hourly = FunctionNode("hourly", lambda c: _bars(spark, sf_dir))
    counts = FunctionNode("counts", lambda c: c.tables["hourly"].groupBy(F.date_trunc("day", TIME).cast("timestamp_ntz").alias(TIME), KEY).agg(F.sum("trade_count").alias("n")), {"hourly": hourly})
    run(store, counts)
    wide = store.scan(counts.storage_name).groupBy(F.to_date(TIME).cast("string").alias("day")).pivot(KEY, ["click", "view", "error"]).agg(F.sum("n"))
    return wide
