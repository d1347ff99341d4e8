"""Further queries over the driver tables: stores, files, calendars, models, instruments, streams. Registered with those of queries."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .instruments import curves, position, pricing
from .operators import bars, calendars, fill, merge, models, passes, portfolio, ranges, reshape, rolling, signals
from .operators import watermarks as wm
from .queries import _BARS, _HALVES, _STATS, _W, D_SQL, E_SQL, P_SQL, _bars, _daily, _halves, _stats, ntz, panel_d, panel_e, panel_p, query, r6, shared_folder, table, untied
from .schema import KEY, TIME, coerce_timestamp, duplicated, normalize, restore_types
from .sources import entities, files
from .sources.store import PanelStore
from .streaming import live


def _store(spark: SparkSession) -> PanelStore:
    return PanelStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


# -- stores


@query(E_SQL + " SELECT time_index, unique_identifier, value FROM e WHERE time_index >= TIMESTAMP '2024-01-09 19:00:00' AND time_index <= TIMESTAMP '2024-01-20 03:00:00'")
def stored_range_read(spark, sf_dir):
    """Bounds with offsets on both sides of UTC, over day partitions: what is pruned is what the filter would drop."""
    from datetime import timedelta, timezone

    store = _store(spark)
    e = merge.keep_one(panel_e(spark, sf_dir), ["event_id"]).select(F.col(TIME).cast("timestamp").alias(TIME), KEY, "value")
    store.upsert(e, "events", partition="day")
    start = datetime(2024, 1, 10, 0, 0, tzinfo=timezone(timedelta(hours=5)))
    end = datetime(2024, 1, 19, 22, 0, tzinfo=timezone(timedelta(hours=-5)))
    return store.read("events", start, end, columns=["value"]).withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


@query(P_SQL + _HALVES + " SELECT time_index, unique_identifier, volume FROM b UNION ALL SELECT time_index, unique_identifier, volume FROM i ANTI JOIN b USING (time_index, unique_identifier)")
def stored_compaction(spark, sf_dir):
    """Two files of different keys, a column dropped, then compacted, read as a view."""
    store = _store(spark)
    base, new = _halves(spark, sf_dir)
    store.upsert(base, "p", partition="month")
    store.upsert(merge.insert_absent(store.scan("p").hint("merge"), new.drop("flag")), "p")
    store.drop_columns("p", ["price"])
    store.compact("p")
    store.vacuum("p")
    name = f"p_{uuid.uuid4().hex}"
    store.view("p", name)
    return spark.sql(f"SELECT {TIME}, {KEY}, volume FROM {name}")


@query("SELECT 'events' AS name, true AS known, 'local' AS side UNION ALL SELECT 'prices', true, 'both' UNION ALL SELECT 'gone', false, 'remote'")
def store_catalog(spark, sf_dir):
    """Tables that exist, are listed, dropped and reconciled with another catalogue."""
    store = _store(spark)
    few = _daily(spark, sf_dir).groupBy(TIME).agg(F.lit("all").alias(KEY), F.avg("price").alias("price"))
    for name in ("events", "prices", "gone"):
        store.upsert(few, name)
    store.drop("gone")
    remote = spark.createDataFrame([("prices",), ("gone",)], "name string")
    sides = store.reconcile(remote)
    rows = [(n, store.exists(n), "local" if n in sides["only_local"] else "remote" if n in sides["only_remote"] else "both") for n in ("events", "prices", "gone")]
    assert store.names() == ["events", "prices"]
    return spark.createDataFrame(rows, "name string, known boolean, side string")


@query(E_SQL + " SELECT time_index, unique_identifier, value FROM e WHERE time_index < TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (SELECT count(*) FROM (SELECT sum(count(*)) OVER (ORDER BY CAST(time_index AS DATE)) AS n FROM e GROUP BY CAST(time_index AS DATE)) WHERE n <= (SELECT count(*) // 2 FROM e))")
def capped_read(spark, sf_dir):
    """The earliest days that come to half of all rows at most."""
    store = _store(spark)
    e = panel_e(spark, sf_dir).select(TIME, KEY, "value")
    store.upsert(e, "events", partition="day")
    return store.capped("events", e.count() // 2, columns=["value"])


@query(E_SQL + ", m AS (SELECT unique_identifier, max(time_index) AS t FROM e GROUP BY ALL) SELECT min(t) AS min_time, max(t) AS max_time FROM m WHERE CAST(unique_identifier AS INT) % 2 = 0")
def subset_watermark_span(spark, sf_dir):
    """Earliest and latest watermark of the entities asked for."""
    e = panel_e(spark, sf_dir)
    stats = wm.watermarks(e).select(KEY, F.col("max_time").alias("min_time"), "max_time")
    return wm.span(stats, e.where(F.col(KEY).cast("int") % 2 == 0).select(KEY))


# -- files


def _written(spark: SparkSession, df: DataFrame, **options) -> str:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    df.write.options(**({"header": True} | options)).csv(path)
    return path


_FIGI = "WITH r AS (SELECT l_shipdate AS time_index, l_suppkey, round(avg(l_extendedprice) + 1e-8, 4) AS price, round(avg(l_discount) + 1e-8, 6) AS weight FROM lineitem GROUP BY ALL)"


def _external(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias(TIME), F.concat(F.lit("F"), F.col("l_suppkey")).alias("figi"))
    rows = l.agg(untied(F.avg("l_discount"), "weight"), r6(F.avg("l_extendedprice") + 1e-8, "price", 4))
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("F"), F.col("s_suppkey")).alias("figi"), F.concat(F.lit("s"), F.col("s_suppkey")).alias(KEY))
    return rows, names


@query(_FIGI + " SELECT time_index, 's' || l_suppkey AS unique_identifier, price AS open FROM r JOIN supplier ON s_suppkey = l_suppkey")
def external_prices(spark, sf_dir):
    rows, names = _external(spark, sf_dir)
    return files.external_prices(spark, _written(spark, rows.select(TIME, "figi", "price")), names).withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


@query(_FIGI + " SELECT time_index, 's' || l_suppkey AS unique_identifier, weight AS signal_weight FROM r JOIN supplier ON s_suppkey = l_suppkey")
def external_weights(spark, sf_dir):
    rows, names = _external(spark, sf_dir)
    return files.external_weights(spark, _written(spark, rows.select(TIME, "figi", "weight", "price")), names).withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


@query("SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS fixing_date, (year(l_shipdate) - 1990) / 100.0 AS rate FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-06-30'")
def fixings_file(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "MM/dd/yyyy").alias("date"), (F.year("l_shipdate") - 1990).cast("double").alias("rate")).distinct()
    out = files.fixings_csv(spark, _written(spark, l), date(1999, 6, 30))
    return out.select(F.col("fixing_date").cast("string").alias("fixing_date"), r6("rate", "rate"))


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS d FROM orders) SELECT 'c' AS curve_id, date_diff('day', (SELECT min(d) FROM d), d)::INTEGER AS days, month(d) / 100.0 AS zero FROM d")
def curve_file(spark, sf_dir):
    # two digits of a year are read as one after 2000
    d = table(spark, sf_dir, "orders").select(F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")).alias("d")).distinct()
    rows = d.select(F.date_format("d", "yyMMdd").alias("date"), F.month("d").cast("double").alias("rate"))
    return files.curve_csv(spark, _written(spark, rows, header=False), "c").select("curve_id", "days", r6("zero", "zero"))


@query("SELECT c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_regionkey < 3 AND c_name LIKE 'Customer%'")
def entity_filters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("nation", F.struct("n_name", "n_regionkey"))
    return entities.filtered(c, c_acctbal__gte=0, c_mktsegment__in=["BUILDING", "MACHINERY"], nation__n_regionkey__lt=3, c_name__startswith="Customer").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01'")
def snapshots_as_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("effective_from"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("effective_to"))
    return entities.as_of(o, datetime(1997, 1, 1)).select("o_orderkey")


@query(P_SQL + " SELECT time_index, unique_identifier, n FROM (SELECT time_index, unique_identifier, count(*) AS n FROM p GROUP BY ALL) WHERE n > 1")
def repeated_keys(spark, sf_dir):
    return duplicated(panel_p(spark, sf_dir)).select(TIME, KEY, "n")


# -- ingest


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) AS us FROM events")
def timestamps_from_epochs(spark, sf_dir):
    """Milliseconds, seconds, and ISO texts become the same time."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e = e.select("event_id", F.unix_millis("at").alias("ms"), F.unix_seconds("at").alias("s"), F.col("ts").cast("string").alias("iso"))
    made = {c: coerce_timestamp(F.col(c), e.schema[c].dataType) for c in ("ms", "s", "iso")}
    return e.select("event_id", F.unix_millis(made["ms"]).alias("ms"), F.unix_micros(made["s"]).alias("s"), F.unix_micros(made["iso"]).alias("us"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 10 THEN round(1 / (l_quantity - 10), 6) END AS inverse, CASE WHEN l_discount > 0 THEN l_discount END AS known FROM lineitem")
def normalized(spark, sf_dir):
    """Infinities and NaN become null."""
    q = F.col("l_quantity") - 10
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(q == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), q)).alias("inverse"), F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(float("nan")).alias("known"))
    return normalize(l, ("l_orderkey",)).select(F.col("l_orderkey"), "l_linenumber", r6("inverse", "inverse"), "known")


@query("SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS INTEGER) AS customer, o_orderstatus AS status FROM orders")
def restored_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"))
    return restore_types(o, {"price": "double", "customer": "int"})


@query("SELECT DISTINCT l_suppkey AS unique_identifier FROM lineitem")
def distinct_ids(spark, sf_dir):
    return ranges.distinct_ids(table(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias(KEY))


@query(D_SQL + " SELECT 'price' AS column_name, count(*) FILTER (volume % 7 = 0) AS n_missing, count(*) AS n FROM d UNION ALL SELECT 'volume', 0, count(*) FROM d")
def missing_values(spark, sf_dir):
    d = panel_d(spark, sf_dir).withColumn("price", F.when(F.col("volume") % 7 != 0, F.col("price")))
    return ranges.missing_values(d, ["price", "volume"])


# -- calendars and bars


@query(E_SQL + " SELECT CAST(day AS VARCHAR) AS session, day + INTERVAL 1 MINUTE * CASE WHEN day >= DATE '2024-03-10' AND day < DATE '2024-11-03' THEN 810 ELSE 870 END AS opens, day + INTERVAL 1 MINUTE * (CASE WHEN day >= DATE '2024-03-10' AND day < DATE '2024-11-03' THEN 1200 ELSE 1260 END - CASE WHEN day IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN 180 ELSE 0 END) AS closes FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-05-27', DATE '2024-06-19', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25')")
def exchange_sessions(spark, sf_dir):
    s = calendars.sessions(spark, date(2024, 1, 1), date(2024, 12, 31), "XNYS")
    return s.select(F.col("session").cast("string").alias("session"), F.col("market_open").cast("timestamp_ntz").alias("opens"), F.col("market_close").cast("timestamp_ntz").alias("closes"))


def _jan(spark) -> DataFrame:
    """Sessions from 8:00 to 20:00 of every day."""
    days = spark.range(1).select(F.explode(F.sequence(ntz(2024, 1, 1), ntz(2024, 1, 30), F.expr("INTERVAL 1 DAY"))).alias("d"))
    return days.select(F.to_date("d").alias("session"), (F.col("d") + F.expr("INTERVAL 8 HOURS")).alias("market_open"), (F.col("d") + F.expr("INTERVAL 20 HOURS")).alias("market_close"))


_INTRA = """, s AS (SELECT CAST(d AS DATE) AS s, d + INTERVAL 8 HOUR AS o, d + INTERVAL 20 HOUR AS c FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d)),
    h AS (SELECT * REPLACE (CASE WHEN trade_count % 3 = 0 THEN NULL ELSE vwap END AS vwap, CASE WHEN trade_count % 5 = 0 THEN NULL ELSE close END AS close) FROM b),
    m AS (SELECT h.*, s.s, s.o, s.c FROM h JOIN s ON h.time_index BETWEEN s.o AND s.c),
    y AS (SELECT unique_identifier, s, o, c, max(time_index) AS last FROM m GROUP BY ALL HAVING count(*) FILTER (open IS NOT NULL AND close IS NOT NULL) > 0),
    z AS (SELECT *, CASE WHEN s = max(s) OVER (PARTITION BY unique_identifier) THEN last ELSE c END AS e FROM y), g AS (SELECT unique_identifier, unnest(generate_series(o, e, INTERVAL 1 HOUR)) AS time_index FROM z),
    a AS (SELECT time_index, unique_identifier FROM g UNION SELECT time_index, unique_identifier FROM m),
    f AS (SELECT a.*, m.open, m.high, m.volume, m.trade_count, m.close IS NULL AS interpolated, last_value(m.close IGNORE NULLS) OVER w AS close, last_value(m.vwap IGNORE NULLS) OVER w AS vwap FROM a LEFT JOIN m USING (time_index, unique_identifier) WINDOW w AS (PARTITION BY a.unique_identifier ORDER BY a.time_index ROWS UNBOUNDED PRECEDING)),
    i AS (SELECT time_index, unique_identifier, CASE WHEN interpolated THEN close ELSE open END AS open, CASE WHEN interpolated THEN close ELSE high END AS high, close, coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count, vwap, interpolated FROM f SEMI JOIN g USING (time_index, unique_identifier) WHERE close IS NOT NULL)"""


def _holed(spark, sf_dir) -> DataFrame:
    return _bars(spark, sf_dir).withColumns({"vwap": F.when(F.col("trade_count") % 3 != 0, F.col("vwap")), "close": F.when(F.col("trade_count") % 5 != 0, F.col("close"))})


@query(_BARS + _INTRA + " SELECT time_index, unique_identifier, open, high, close, volume, trade_count, round(vwap + 1e-8, 6) AS vwap, interpolated FROM i")
def intraday_gap_fill(spark, sf_dir):
    out = bars.fill_intraday(_holed(spark, sf_dir), _jan(spark), "1h")
    return out.select(TIME, KEY, "open", "high", "close", "volume", "trade_count", untied("vwap", "vwap"), "interpolated")


@query(_BARS + _INTRA + """, u AS (SELECT time_index, unique_identifier, first_value(open) OVER w AS open, max(high) OVER w AS high, close, sum(volume) OVER w AS volume, CAST(sum(trade_count) OVER w AS BIGINT) AS trade_count, interpolated, count(*) OVER w AS n FROM i WINDOW w AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT time_index, unique_identifier, open, high, close, volume, trade_count, interpolated FROM u WHERE n = 3 AND time_index > TIMESTAMP '2024-01-05'""")
def interpolated_prices(spark, sf_dir):
    """The node: filled by the hour, combined into bars of three hours, rows after the watermark only."""
    b = _holed(spark, sf_dir)
    since = b.select(KEY).distinct().withColumn("max_time", ntz(2024, 1, 5))
    out = bars.interpolated_prices(b, _jan(spark), "1h", "3h", since)
    return out.select(TIME, KEY, "open", "high", "close", "volume", "trade_count", "interpolated")


@query(
    _BARS + """, h AS (SELECT time_index, unique_identifier, open, close, CASE WHEN trade_count % 3 = 0 THEN NULL ELSE vwap END AS vwap, volume, trade_count FROM b), d AS (SELECT unique_identifier, date_trunc('day', time_index) + INTERVAL 1439 MINUTE AS time_index, arg_max(open, time_index) AS open, arg_max(close, time_index) AS close, arg_max(CASE WHEN vwap IS NULL THEN -1 ELSE vwap END, time_index) AS v, sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM h GROUP BY ALL),
    q AS (SELECT *, v = -1 AS interpolated FROM d) SELECT time_index, unique_identifier, CASE WHEN interpolated THEN close ELSE open END AS open, close, volume, trade_count, interpolated FROM q"""
)
def daily_gap_fill_partial(spark, sf_dir):
    """Bars with a single missing value are repaired, and keep the volume and the trades that they have."""
    b = _bars(spark, sf_dir).withColumn("vwap", F.when(F.col("trade_count") % 3 != 0, F.col("vwap")))
    day = (F.date_trunc("day", TIME) + F.expr("INTERVAL 1439 MINUTES")).cast("timestamp_ntz")
    d = b.groupBy(KEY, day.alias("day")).agg(*(F.max_by(c, TIME).alias(c) for c in ("open", "close", "vwap")), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"))
    days = _jan(spark).select("session", (F.col("market_open") - F.expr("INTERVAL 8 HOURS")).alias("market_open"), (F.col("market_open") + F.expr("INTERVAL 959 MINUTES")).alias("market_close"))
    return bars.fill_daily(d.withColumnRenamed("day", TIME), days).select(TIME, KEY, "open", "close", "volume", "trade_count", "interpolated")


@query("SELECT CAST(d AS VARCHAR) AS session, d + INTERVAL 20 HOUR AS grid, d + INTERVAL 8 HOUR AS rebalance FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS d)")
def portfolio_and_rebalance_grids(spark, sf_dir):
    grid = calendars.portfolio_grid(_jan(spark), datetime(2024, 1, 20, 23)).select(F.col(TIME).alias("grid"), F.to_date(TIME).alias("session"))
    times = calendars.rebalance_times(_jan(spark)).select(F.col(TIME).alias("rebalance"), F.to_date(TIME).alias("session"))
    return grid.join(times, "session").select(F.col("session").cast("string").alias("session"), "grid", "rebalance")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '24/7' WHEN s_suppkey % 3 = 0 THEN 'XLON' ELSE 'XNYS' END AS calendar FROM supplier")
def calendar_by_entity(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind, at = F.when(F.col("s_suppkey") % 5 == 0, "CRYPTO").otherwise("EQUITY"), F.when(F.col("s_suppkey") % 3 == 0, "LN").otherwise("US")
    return s.select("s_suppkey", calendars.calendar_of(kind, at, {"LN": "XLON"}).alias("calendar"))


@query(E_SQL + " SELECT unique_identifier, date_trunc('week', time_index) + INTERVAL 6 DAY AS time_index, arg_max(value, (time_index, event_id)) AS value FROM e GROUP BY ALL")
def weekly_last(spark, sf_dir):
    return fill.weekly_last(merge.keep_one(panel_e(spark, sf_dir), ["event_id"]), ["value"]).select(TIME, KEY, "value")


# -- sets and shapes


@query(E_SQL + " SELECT time_index, unique_identifier FROM e WHERE event_type = 'click' UNION SELECT time_index, unique_identifier FROM e WHERE value > 50")
def union_distinct(spark, sf_dir):
    e = panel_e(spark, sf_dir)
    return merge.union_distinct(e.where("event_type = 'click'").select(TIME, KEY), e.where("value > 50").select(TIME, KEY))


@query("SELECT ts AS time_index FROM events UNION SELECT l_shipdate FROM lineitem")
def time_grid(spark, sf_dir):
    return merge.time_grid(panel_e(spark, sf_dir), panel_p(spark, sf_dir))


@query("SELECT s_name AS name FROM supplier EXCEPT SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def names_on_one_side(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    busy = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_suppkey").distinct()
    return merge.names_only_left(s.select(F.col("s_name").alias("name")), s.join(busy, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_name").alias("name")))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem")
def flattened_positions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("quantity"))).alias("holdings"))
    return reshape.flatten_positions(l)


@query(r"SELECT doc_id, array_to_string(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+')[1:8], ' ') AS beginning FROM documents")
def first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reshape.first_words(F.coalesce("text", F.lit("")), 8).alias("beginning"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def entity_predicate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"security_type": F.col("c_mktsegment"), "sector": F.lit("x")})
    return c.where(ranges.entity_filter("BUILDING", None)).select("c_custkey", "c_mktsegment")


@query(E_SQL + " SELECT time_index, unique_identifier, value FROM e WHERE (unique_identifier = '1' OR unique_identifier = '4' AND time_index >= TIMESTAMP '2024-01-10') AND time_index < TIMESTAMP '2024-01-20'")
def range_map_and_bounds(spark, sf_dir):
    """Ranges added to the time bounds rather than in their place."""
    made = {"1": ranges.Range(), "4": ranges.Range(datetime(2024, 1, 10))}
    return ranges.range_read(panel_e(spark, sf_dir), end=datetime(2024, 1, 20), less_or_equal=False, columns=["value"], ranges=made, combine="and")


# -- signals, portfolios, models


@query("SELECT TIMESTAMP '1985-01-01' AS time_index, x.* FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.3::DOUBLE), ('c', 0.2::DOUBLE)) x(unique_identifier, signal_weight)")
def fixed_weights(spark, sf_dir):
    return signals.fixed_weights(spark, {"a": 0.5, "b": 0.3, "c": 0.2}).withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))


@query(D_SQL + ", q AS (SELECT *, price / lag(price) OVER w - 1 AS r FROM d" + _W + "), s AS (SELECT time_index, unique_identifier, count(r) OVER a AS n, stddev_samp(r) OVER a AS sd FROM q WHERE true WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT time_index, unique_identifier, CASE WHEN n = 20 THEN round(sd * sqrt(6048), 5) END AS volatility FROM s")
def realized_volatility(spark, sf_dir):
    d = panel_d(spark, sf_dir).withColumn("r", rolling.padded_return(F.col("price")))
    return d.select(TIME, KEY, r6(rolling.realized_volatility(F.col("r"), 20), "volatility", 5))


@query(
    D_SQL + """, l AS (SELECT time_index, unique_identifier, list(price) OVER (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 226 PRECEDING AND CURRENT ROW) AS x FROM d)
    SELECT time_index, unique_identifier, round(list_sum(list_transform(x, lambda v, i: v * CASE WHEN i = 1 THEN power(1 - 2.0 / 14, len(x) - 1) ELSE 2.0 / 14 * power(1 - 2.0 / 14, len(x) - i) END)), 5) AS ema FROM l"""
)
def exponential_average(spark, sf_dir):
    """In chunks of a year, each scanned by itself and composed with those before."""
    d = passes.exponential(panel_d(spark, sf_dir).select(TIME, KEY, "price"), {"ema": ("mean", F.col("price"), 13)}, chunk=F.year(TIME))
    return d.select(TIME, KEY, r6("ema", "ema", 5))


@query(
    D_SQL + """, r AS (SELECT *, lag(price) OVER w AS prev, lead(price) OVER w AS next FROM d""" + _W + """), f AS (SELECT *, avg(price) OVER a AS sma, count(price) OVER a AS n FROM r WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT time_index, unique_identifier, round(sma + 1e-8, 6) AS sma, volume, round(next / price - 1, 6) AS target FROM f WHERE n = 5 AND next IS NOT NULL"""
)
def model_table(spark, sf_dir):
    """Features of a day joined to the return that the entity's next day brings."""
    d = panel_d(spark, sf_dir)
    features = d.select(TIME, KEY, rolling.sma(F.col("price"), 5).alias("sma"), "volume")
    out = models.training_table(features, d, ["sma", "volume"], price="price")
    return out.select(TIME, KEY, untied("sma", "sma"), "volume", r6("target", "target"))


@query(D_SQL + ", w AS (SELECT time_index, unique_identifier, count(*) OVER a AS n, sum(price * volume) OVER a AS xy, sum(volume * volume) OVER a AS xx FROM d WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT time_index, unique_identifier, round(xy / xx + 1e-8, 5) AS b FROM w WHERE n = 10")
def rolling_nnls(spark, sf_dir):
    """Non-negative least squares on one factor, where it has a closed form."""
    out = models.rolling_regression(panel_d(spark, sf_dir), "price", ["volume"], 10)
    return out.where("weights IS NOT NULL").select(TIME, KEY, r6(F.col("weights")["volume"] + 1e-8, "b", 5))


@query(D_SQL + ", w AS (SELECT time_index, unique_identifier, count(*) OVER a AS n, avg(price * volume) OVER a AS xy, avg(volume * volume) OVER a AS xx FROM d WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT time_index, unique_identifier, round(greatest(xy - 500 * 0.7, 0) / (xx + 500 * 0.3) + 1e-8, 5) AS b FROM w WHERE n = 10")
def rolling_elastic_net(spark, sf_dir):
    out = models.rolling_regression(panel_d(spark, sf_dir), "price", ["volume"], 10, alpha=500.0, l1_ratio=0.7)
    return out.where("weights IS NOT NULL").select(TIME, KEY, r6(F.col("weights")["volume"] + 1e-8, "b", 5))


@query(D_SQL + """, m AS (SELECT time_index, unique_identifier, count(*) OVER a AS n, var_pop(price) OVER a AS p, var_pop(volume * 40) OVER a AS q, covar_pop(price, volume * 40) OVER a AS c FROM d WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, c AS u, (p + q) / 2 + sqrt((p - q) * (p - q) / 4 + c * c) - p AS v FROM m WHERE n = 20), s AS (SELECT *, u / (abs(u) + abs(v)) * CASE WHEN u + v >= 0 THEN 1 ELSE -1 END AS a, v / (abs(u) + abs(v)) * CASE WHEN u + v >= 0 THEN 1 ELSE -1 END AS b FROM e) SELECT time_index, unique_identifier, round(a, 4) AS price, round(b, 4) AS volume FROM s WHERE abs(u + v) > 1e-6 * (abs(u) + abs(v))""")
def rolling_pca(spark, sf_dir):
    """First component of two columns, where it has a closed form."""
    out = models.rolling_pca(panel_d(spark, sf_dir).withColumn("volume", F.col("volume") * 40), ["price", "volume"], 20)
    return out.where("loadings IS NOT NULL").select(TIME, KEY, r6(F.col("loadings")["price"], "price", 4), r6(F.col("loadings")["volume"], "volume", 4))


@query(D_SQL + ", m AS (SELECT time_index, unique_identifier, volume, count(*) OVER a AS n, regr_slope(price, volume) OVER a AS b, regr_intercept(price, volume) OVER a AS c FROM d WINDOW a AS (PARTITION BY unique_identifier ORDER BY time_index ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT time_index, unique_identifier, round(c + b * volume, 2) AS predicted FROM m WHERE n = 30")
def rolling_prediction(spark, sf_dir):
    out = models.rolling_predict(panel_d(spark, sf_dir), "price", ["volume"], 30, ridge=0.0)
    return out.where("predicted IS NOT NULL").select(TIME, KEY, r6("predicted", "predicted", 2))


_SHARES = D_SQL + ", s AS (SELECT time_index, unique_identifier, price, volume, volume / sum(volume) OVER (PARTITION BY time_index) AS w FROM d), f AS (SELECT *, coalesce(lag(w) OVER w0, 0) AS wb, lag(price) OVER w0 AS pb FROM s WINDOW w0 AS (PARTITION BY unique_identifier ORDER BY time_index))"


def _moved(spark, sf_dir) -> DataFrame:
    d = panel_d(spark, sf_dir).withColumn("weights", F.col("volume") / F.sum("volume").over(Window.partitionBy(TIME)))
    return portfolio.immediate(d.select(TIME, KEY, "weights", "price", "volume"))


@query(_SHARES + " SELECT time_index, unique_identifier, round(w + 1e-8, 6) AS weights, round(price + 1e-8, 6) AS price, round(wb + 1e-8, 6) AS before FROM f")
def serialized_portfolio(spark, sf_dir):
    """Weights and prices as JSON maps on the portfolio's rows, and read back from them."""
    moved = _moved(spark, sf_dir)
    out = portfolio.serialized(moved.select(TIME).distinct(), moved)
    parts = [reshape.from_map(out.select(TIME, c), c, v, is_json=True) for c, v in (("rebalance_weights", "weights"), ("rebalance_price", "price"), ("weights_at_last_rebalance", "before"))]
    a, b, c = parts
    return a.join(b, [TIME, KEY]).join(c, [TIME, KEY]).select(TIME, KEY, untied("weights", "weights"), untied("price", "price"), untied("before", "before"))


@query(_SHARES + " SELECT unique_identifier, round(w + 1e-8, 6) AS weights, round(price + 1e-8, 6) AS price, volume FROM f WHERE time_index = (SELECT max(time_index) FROM f)")
def restored_weights(spark, sf_dir):
    moved = _moved(spark, sf_dir)
    last = portfolio.last_weights(portfolio.serialized(moved.select(TIME).distinct(), moved))
    return last.select(KEY, untied("weights", "weights"), untied("price", "price"), "volume")


@query(
    D_SQL + """, t AS (SELECT time_index, sum(price * volume) AS close FROM d GROUP BY ALL), s AS (SELECT time_bucket(INTERVAL 7 DAY, time_index, TIMESTAMP '1970-01-01') AS w, arg_max(close, time_index) AS close FROM t GROUP BY ALL), g AS (SELECT unnest(generate_series((SELECT min(w) FROM s), (SELECT max(w) FROM s), INTERVAL 7 DAY)) AS w)
    SELECT g.w AS time_index, round(last_value(close IGNORE NULLS) OVER (ORDER BY g.w ROWS UNBOUNDED PRECEDING), 3) AS close FROM g LEFT JOIN s USING (w)"""
)
def resampled_portfolio(spark, sf_dir):
    t = panel_d(spark, sf_dir).groupBy(TIME).agg(F.sum(F.col("price") * F.col("volume")).alias("close")).withColumn("_k", F.lit("all"))
    return fill.resample_last(t, "7 DAYS", ["close"], ("_k",)).select(TIME, r6("close", "close", 3))


@query("SELECT unique_identifier, min(t) AS first_time, max(t) AS last_time FROM (SELECT 's' || l_suppkey AS unique_identifier, l_shipdate AS t FROM lineitem) GROUP BY ALL HAVING max(t) >= (SELECT min(m) FROM (SELECT max(l_shipdate) AS m FROM lineitem GROUP BY l_suppkey))")
def portfolio_window(spark, sf_dir):
    """From each identifier's first row up to the latest time that all dependencies have reached; those that reach it."""
    p = panel_p(spark, sf_dir)
    stats = wm.watermarks(p)
    until = wm.update_window(stats)
    return stats.join(F.broadcast(until), F.col("max_time") >= F.col("window_end")).select(KEY, F.col("min_time").alias("first_time"), F.col("max_time").alias("last_time"))


# -- instruments


@query("SELECT l_orderkey, l_linenumber, round((1 / (1 + 0.05 * n / 360.0) / (1 / (1 + 0.06 * (n + 90) / 360.0)) - 1) / (90 / 360.0), 8) AS forward, (360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + CASE WHEN day(b) = 31 AND least(day(a), 30) = 30 THEN 30 ELSE day(b) END - least(day(a), 30)) / 360.0 AS thirty, CASE WHEN month(f) = month(b) THEN f ELSE p END::VARCHAR AS adjusted FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 90 AS b, CAST(l_quantity AS INTEGER) * 7 AS n, CAST(l_shipdate AS DATE) + 90 + CAST(CASE isodow(CAST(l_shipdate AS DATE) + 90) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS f, CAST(l_shipdate AS DATE) + 90 - CAST(CASE isodow(CAST(l_shipdate AS DATE) + 90) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS INTEGER) AS p FROM lineitem)")
def rates_and_day_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), 90).alias("b"), (F.col("l_quantity").cast("int") * 7).alias("n"))
    forward = scalar.forward_rate(scalar.discount_factor(F.lit(0.05), F.col("n")), scalar.discount_factor(F.lit(0.06), F.col("n") + 90), F.lit(90 / 360.0))
    return l.select("l_orderkey", "l_linenumber", r6(forward, "forward", 8), scalar.year_fraction(F.col("a"), F.col("b"), "30/360").alias("thirty"), scalar.adjusted(F.col("b"), "MODIFIED").cast("string").alias("adjusted"))


@query("WITH f AS (SELECT l_suppkey, l_quantity / 360.0 AS w, 1 / (1 + 0.04 * l_linenumber) AS d FROM lineitem) SELECT l_suppkey, round(sum(w * d), 6) AS annuity, round((max(d) - min(d)) / sum(w * d), 6) AS par FROM f GROUP BY ALL")
def annuities(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 360.0).alias("w"), (1 / (1 + 0.04 * F.col("l_linenumber"))).alias("d"))
    out = f.groupBy("l_suppkey").agg(scalar.annuity(F.col("w"), F.col("d")).alias("annuity"), F.max("d").alias("first"), F.min("d").alias("last"))
    return out.select("l_suppkey", r6("annuity", "annuity"), r6(scalar.par_rate(F.col("first"), F.col("last"), F.col("annuity")), "par"))


#: Abramowitz and Stegun 7.1.26 is too coarse here: SQL has no erf, so that the normal distribution is summed by its series.
_PHI = "(0.5 + {x} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(generate_series(0, 80), lambda k: list_product(list_concat([1.0::DOUBLE], list_transform(generate_series(1, k), lambda j: {x} * {x} / (2 * j + 1)))))))"
_OPTIONS = "WITH o AS (SELECT p_partkey AS ins_id, p_retailprice AS s, p_retailprice * (0.9 + p_size % 5 * 0.05) AS k, 0.25 + p_size % 4 * 0.25 AS t, 0.15 + p_size % 3 * 0.1 AS v, 0.03::DOUBLE AS r, 0.01::DOUBLE AS q, p_size % 2 = 0 AS call, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS g FROM part), d AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM o), n AS (SELECT *, " + _PHI.format(x="(g * d1)") + " AS n1, " + _PHI.format(x="(g * (d1 - v * sqrt(t)))") + " AS n2 FROM d)"


def _options(spark, sf_dir) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("ins_id"), c("p_retailprice").alias("spot"), (c("p_retailprice") * (0.9 + c("p_size") % 5 * 0.05)).alias("strike"), (0.25 + c("p_size") % 4 * 0.25).alias("years"),
        (0.15 + c("p_size") % 3 * 0.1).alias("volatility"), F.lit(0.03).alias("rate"), F.lit(0.01).alias("carry"), (c("p_size") % 2 == 0).alias("is_call"),
    )


@query(_OPTIONS + " SELECT ins_id, round(g * (s * exp(-q * t) * n1 - k * exp(-r * t) * n2), 6) AS price, round(g * exp(-q * t) * n1, 6) AS delta, round(exp(-q * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (s * v * sqrt(t)), 8) AS gamma, round(s * exp(-q * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) / 100, 6) AS vega, round(g * k * t * exp(-r * t) * n2 / 100, 6) AS rho FROM n")
def option_prices(spark, sf_dir):
    o = pricing.option_prices(_options(spark, sf_dir))
    return o.select("ins_id", r6("price", "price"), r6("delta", "delta"), r6("gamma", "gamma", 8), r6("vega", "vega"), r6("rho", "rho"))


@query(_OPTIONS + " SELECT name, round(sum(x * (ins_id % 5 - 2)), 4) AS value FROM (SELECT ins_id, 'delta' AS name, g * exp(-q * t) * n1 AS x FROM n UNION ALL SELECT ins_id, 'vega', s * exp(-q * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) / 100 FROM n) GROUP BY ALL")
def position_greeks(spark, sf_dir):
    o = pricing.option_prices(_options(spark, sf_dir)).select("ins_id", F.create_map(F.lit("delta"), "delta", F.lit("vega"), "vega").alias("greeks"))
    held = o.select("ins_id", (F.col("ins_id") % 5 - 2).cast("double").alias("units"))
    return position.greeks(o, held).select("name", r6("value", "value", 4))


_DEPOSITS = [(30, 0.05), (90, 0.052), (182, 0.053)]


@query(
    """WITH q AS (SELECT 182.0 / 360 AS t, 1 / (1 + 0.053 * 182 / 360) AS d1), a AS (SELECT t, d1, (1 - 0.054 * t * d1) / (1 + 0.054 * t) AS d2 FROM q), b AS (SELECT t, d1, d2, (1 - 0.055 * t * (d1 + d2)) / (1 + 0.055 * t) AS d3 FROM a), n AS (SELECT r.r_name AS curve_id, x.days, x.df FROM region r, b, LATERAL (VALUES (30, 1 / (1 + 0.05 * 30 / 360)), (90, 1 / (1 + 0.052 * 90 / 360)), (182, d1), (364, d2), (546, d3)) x(days, df))
    SELECT curve_id, days, round((1 / df - 1) * 360 / days, 8) AS zero FROM n"""
)
def bootstrapped_curve(spark, sf_dir):
    quotes = spark.createDataFrame([("deposit", d, r) for d, r in _DEPOSITS] + [("swap", 364, 0.054), ("swap", 546, 0.055)], "kind string, days int, rate double")
    q = table(spark, sf_dir, "region").select(F.col("r_name").alias("curve_id")).crossJoin(F.broadcast(quotes))
    return curves.bootstrap(q).select("curve_id", "days", r6("zero", "zero", 8))


@query("WITH c AS (SELECT s_suppkey AS ins_id, s_suppkey % 3 = 0 AS moved FROM supplier) SELECT ins_id, CASE WHEN moved THEN 'b' ELSE 'a' END AS curve_id, round(1 / (1 + (CASE WHEN moved THEN 0.04 ELSE 0.05 + 0.0001 END + 0.001) * 365 / 360.0), 8) AS df FROM c")
def bumped_and_moved_curves(spark, sf_dir):
    """A parallel and a key-rate shift, and instruments moved to another curve."""
    nodes = spark.createDataFrame([("a", 30, 0.03), ("a", 365, 0.05), ("b", 365, 0.0399)], "curve_id string, days int, zero double")
    nodes = curves.bumped(nodes, 0.001, {365: 0.0001})
    i = position.with_curve(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ins_id"), F.lit("a").alias("curve_id"), F.lit(365).alias("days")), F.col("ins_id") % 3 == 0, "b")
    return curves.discounted(i, nodes).select("ins_id", "curve_id", r6("df", "df", 8))


@query("SELECT o_orderkey, o_totalprice AS rate, o_orderdate AS time_index FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def past_fixings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("rate"), F.col("o_orderdate").alias(TIME))
    return curves.fixings(o, datetime(1998, 1, 1))


@query("SELECT r_name AS curve_id, x.* FROM region, (VALUES (30, 0.05::DOUBLE), (365, 0.055::DOUBLE)) x(days, zero)")
def curve_codec(spark, sf_dir):
    """Curves packed into text cells and back."""
    cells = table(spark, sf_dir, "region").select(F.col("r_name").alias("curve_id"), scalar.curve_cell(F.create_map(F.lit(30), F.lit(0.05), F.lit(365), F.lit(0.055))).alias("cell"))
    return cells.select("curve_id", F.explode(scalar.curve_nodes("cell")).alias("days", "zero"))


_FLAT = "WITH b AS (SELECT s_suppkey AS ins_id, 100.0 * (1 + s_suppkey % 5) AS face, 0.02 + 0.01 * (s_suppkey % 4) AS coupon FROM supplier), p AS (SELECT * FROM (VALUES (DATE '2024-01-02', DATE '2024-07-02'), (DATE '2024-07-02', DATE '2025-01-02')) x(a, z)), f AS (SELECT ins_id, face, z, face * coupon * date_diff('day', a, z) / 360.0 AS amount FROM b, p UNION ALL SELECT ins_id, face, DATE '2025-01-02', face FROM b), v AS (SELECT *, date_diff('day', DATE '2024-03-01', z) AS n, 1 / (1 + 0.05 * 360 / 360.0) AS df1 FROM f), w AS (SELECT *, exp(ln(df1) * n / 360.0) AS df FROM v)"


def _bonds(spark, sf_dir):
    k = F.col("s_suppkey")
    bonds = table(spark, sf_dir, "supplier").select(k.alias("ins_id"), (100.0 * (1 + k % 5)).alias("face"), (0.02 + 0.01 * (k % 4)).alias("coupon"), F.lit("2024-01-02").cast("date").alias("start_date"), F.lit("2025-01-02").cast("date").alias("end_date"), F.lit(6).alias("months"), F.lit("c").alias("curve_id"))
    return bonds, spark.createDataFrame([("c", 360, 0.05)], "curve_id string, days int, zero double")


@query(_FLAT + ", s AS (SELECT ins_id, sum(amount * df) AS npv FROM w GROUP BY ALL) SELECT ins_id, round(npv, 6) AS npv, round(100 * coupon * 59 / 360.0, 6) AS accrued, round(npv / face * 100 - 100 * coupon * 59 / 360.0, 6) AS clean FROM s JOIN b USING (ins_id)")
def bond_prices(spark, sf_dir):
    bonds, nodes = _bonds(spark, sf_dir)
    return pricing.bond_prices(bonds, nodes, F.lit("2024-03-01").cast("date")).select("ins_id", r6("npv", "npv"), r6("accrued", "accrued"), r6("clean", "clean"))


@query(_FLAT + " SELECT ins_id, round(0.06 + ins_id % 3 * 0.01, 8) AS yield FROM b")
def bond_yields(spark, sf_dir):
    """Prices made at a known yield give it back."""
    bonds, _ = _bonds(spark, sf_dir)
    flows, at = pricing.bond_cashflows(bonds), F.lit("2024-03-01").cast("date")
    days = F.datediff("payment_date", at)
    made = flows.where(days > 0).groupBy("ins_id").agg(F.sum(F.col("amount") * F.exp(-(0.06 + F.col("ins_id") % 3 * 0.01) * days / 365.0)).alias("value"))
    return pricing.yields(flows, made, at).select("ins_id", r6("yield", "yield", 8))


# -- streams, run on what is there


@query(_BARS + " SELECT time_index, unique_identifier, close, trade_count FROM b")
def streamed_upsert(spark, sf_dir):
    """Bars written as files, read as a stream, and upserted batch by batch; delivered twice, stored once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _bars(spark, sf_dir).select(TIME, KEY, "close", "trade_count").repartition(3).write.parquet(f"{folder}/in")
    store = PanelStore(spark, f"{folder}/store")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for again in ("a", "b"):
        live.upsert_stream(stream, store, "bars", f"{folder}/checkpoint-{again}").awaitTermination()
    return store.scan("bars")


@query(E_SQL + _STATS + " SELECT unique_identifier, max_time FROM s WHERE max_time >= TIMESTAMP '2024-01-14'")
def live_watermarks(spark, sf_dir):
    return _stats(panel_e(spark, sf_dir)).where(F.col("max_time") >= ntz(2024, 1, 14)).select(KEY, "max_time")


@query(_BARS + _INTRA + " SELECT time_index, unique_identifier, open, high, close, volume, trade_count, round(vwap + 1e-8, 6) AS vwap, interpolated FROM i")
def streamed_gap_fill(spark, sf_dir):
    """Bars laid down as files by half months and read as a stream with state; it is stopped after each and started again."""
    from .streaming import state

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    b = _holed(spark, sf_dir)
    half = F.floor((F.dayofmonth(TIME) - 1) / 16)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        for k in range(3):
            part = b.where(half == k) if k < 2 else state.closing(b, datetime(2024, 6, 1))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            filled = state.fill_stream(stream, _jan(spark), "1h", "1 hour")
            filled.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.schema(filled.schema).parquet(f"{folder}/out")
    return out.select(TIME, KEY, "open", "high", "close", "volume", "trade_count", untied("vwap", "vwap"), "interpolated")


@query(E_SQL + " SELECT time_index, unique_identifier, value, event_id FROM e WHERE time_index >= TIMESTAMP '2024-01-10' AND time_index < TIMESTAMP '2024-01-20 12:00:00' AND unique_identifier IN ('1', '4', '9', '12')")
def paged_range_read(spark, sf_dir):
    """Events laid down as pages of a hundred keys each and read by bounds of time and identifiers."""
    from .sources import paged

    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    e = panel_e(spark, sf_dir).select(TIME, KEY, "value", "event_id")
    paged.write_pages(e, path)
    paged.register(spark)
    found = spark.read.format("paged").schema(e.schema).load(path)
    return found.where((F.col(TIME) >= ntz(2024, 1, 10)) & (F.col(TIME) < ntz(2024, 1, 20) + F.expr("INTERVAL 12 HOURS")) & F.col(KEY).isin("1", "4", "9", "12"))
