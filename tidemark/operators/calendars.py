"""Trading sessions as tables, 24/7 and the New York and London exchanges by rule, in UTC; business days by their ordinals."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _easter(year: int) -> date:
    """Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    n = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * n) // 451
    month, day = divmod(h + n - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(day: date) -> date | None:
    """Sunday holidays move to Monday, Saturday ones to Friday."""
    return day + timedelta(1) if day.weekday() == 6 else day - timedelta(1) if day.weekday() == 5 else day


def xnys_holidays(year: int) -> set[date]:
    new_year = date(year, 1, 1)
    days = {
        new_year + timedelta(1) if new_year.weekday() == 6 else new_year,  # a Saturday one isn't moved to the old year
        _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1),
        _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25)),
    }
    if year >= 2022:
        days.add(_observed(date(year, 6, 19)))
    return days


def xnys_early(year: int) -> set[date]:
    """Days that close at 13:00: the day after Thanksgiving, Christmas Eve and 3 July on weekdays that trade."""
    days = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 12, 24), date(year, 7, 3)}
    if date(year, 7, 4).weekday() in (0, 5, 6):
        days.discard(date(year, 7, 3))
    return {d for d in days if d.weekday() < 5} - xnys_holidays(year)


#: Days on which London was closed, or open in place of a moved holiday, by proclamation. Fixed values.
XLON_ADDED = (date(1995, 5, 8), date(1999, 12, 31), date(2002, 6, 3), date(2002, 6, 4), date(2011, 4, 29), date(2012, 6, 4), date(2012, 6, 5), date(2020, 5, 8), date(2022, 6, 2), date(2022, 6, 3), date(2022, 9, 19), date(2023, 5, 8))
XLON_MOVED = (date(1995, 5, 1), date(2002, 5, 27), date(2012, 5, 28), date(2020, 5, 4), date(2022, 5, 30))


def xlon_holidays(year: int) -> set[date]:
    """Bank holidays of England; Christmas, Boxing Day and New Year's Day on a weekend are kept on the next weekdays."""
    new_year, christmas = date(year, 1, 1), date(year, 12, 25)
    moved = {5: 2, 6: 1}.get(new_year.weekday(), 0)
    days = {new_year + timedelta(moved), _easter(year) - timedelta(2), _easter(year) + timedelta(1), _nth(year, 5, 0, 1), _nth(year, 5, 0, -1), _nth(year, 8, 0, -1)}
    days |= {date(year, 12, d) for d in {4: (25, 28), 5: (27, 28), 6: (26, 27)}.get(christmas.weekday(), (25, 26))}
    return (days | {d for d in XLON_ADDED if d.year == year}) - set(XLON_MOVED)


def xlon_early(year: int) -> set[date]:
    """Days that close at 12:30: the last trading days before Christmas and New Year."""
    out = set()
    for day in (date(year, 12, 24), date(year, 12, 31)):
        while day.weekday() > 4 or day in xlon_holidays(year):
            day -= timedelta(1)
        out.add(day)
    return out


#: Holidays, early closes, zone, open, close and early close in minutes of the day.
EXCHANGES = {"XNYS": (xnys_holidays, xnys_early, "America/New_York", 570, 960, 780), "XLON": (xlon_holidays, xlon_early, "Europe/London", 480, 990, 750)}


def open_days(spark: SparkSession, start: date, end: date, *calendars: str) -> DataFrame:
    """(day, is_open, n): every day from start to end, whether all the calendars are open, and how many open days there are up to it.

    n makes business days arithmetic: rolling, moving and counting are lookups of it. A row a day: small at any span.
    """
    years = range(start.year, end.year + 1)
    closed = sorted({d for name in calendars for y in years for d in EXCHANGES[name][0](y)})
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    is_open = (F.weekday("day") < 5) & ~F.array_contains(F.array(*map(F.lit, closed)).cast("array<date>"), F.col("day"))
    days = days.withColumn("is_open", is_open if calendars else F.lit(True))
    return days.withColumn("n", F.sum(F.col("is_open").cast("long")).over(Window.orderBy("day")))


def _at(df: DataFrame, days: DataFrame, column: str, tag: str) -> DataFrame:
    """Adds the place of a date in a calendar: _n and _open with the tag; null outside it."""
    return df.join(F.broadcast(days.select(F.col("day").alias(f"_d{tag}"), F.col("n").alias(f"_n{tag}"), F.col("is_open").alias(f"_open{tag}"))), F.col(column) == F.col(f"_d{tag}"), "left").drop(f"_d{tag}")


def _nth_open(df: DataFrame, days: DataFrame, n: Column, out: str) -> DataFrame:
    """Adds the n-th open day of a calendar; null outside it."""
    return df.withColumn("_k", n).join(F.broadcast(days.where("is_open").select(F.col("n").alias("_m"), F.col("day").alias(out))), F.col("_k") == F.col("_m"), "left").drop("_k", "_m")


def rolled(df: DataFrame, days: DataFrame, column: str, out: str, rule: str = "MODIFIED") -> DataFrame:
    """Adds the open day for a date: itself, else the next one (FOLLOWING), the one before (PRECEDING), or the next one unless it is in another month (MODIFIED)."""
    at = _at(df, days, column, "")
    after = F.col("_n") + F.when(F.col("_open"), 0).otherwise(1)
    if rule != "MODIFIED":
        return _nth_open(at, days, after if rule == "FOLLOWING" else F.col("_n"), out).drop("_n", "_open")
    both = _nth_open(_nth_open(at, days, after, "_next"), days, F.col("_n"), "_last")
    kept = F.when(F.trunc("_next", "month") == F.trunc(column, "month"), F.col("_next")).otherwise(F.col("_last"))
    return both.withColumn(out, kept).drop("_n", "_open", "_next", "_last")


def moved(df: DataFrame, days: DataFrame, column: str, by: int, out: str) -> DataFrame:
    """Adds the day that is ``by`` open days after a date, which counts as the next open one if it isn't open itself; spot is by = 2."""
    at = _at(df, days, column, "")
    return _nth_open(at, days, F.col("_n") + F.when(F.col("_open"), 0).otherwise(1) + by, out).drop("_n", "_open")


def counted(df: DataFrame, days: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Adds the number of open days after start, up to and including end."""
    at = _at(_at(df, days, start, "1"), days, end, "2")
    return at.withColumn(out, F.col("_n2") - F.col("_n1")).drop("_n1", "_n2", "_open1", "_open2")


def sessions(spark: SparkSession, start: date, end: date, calendar: str = "24/7") -> DataFrame:
    """(session date, market_open, market_close) in UTC for each trading day in [start, end]. A day a row: small at any span."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session"))
    if calendar == "24/7":
        at = F.col("session").cast("timestamp")
        return days.select("session", at.alias("market_open"), (at + F.expr("INTERVAL 1439 MINUTES")).alias("market_close"))
    if calendar not in EXCHANGES:
        raise ValueError(f"no calendar: {calendar}")
    holidays, shortened, zone, opens, closes, closes_early = EXCHANGES[calendar]
    years = range(start.year, end.year + 1)
    closed = [d for y in years for d in sorted(holidays(y))]
    early = [d for y in years for d in sorted(shortened(y))]
    listed = lambda ds: F.array(*map(F.lit, ds)).cast("array<date>")
    trading = days.where((F.weekday("session") < 5) & ~F.array_contains(listed(closed), F.col("session")))
    local = lambda minutes: F.to_utc_timestamp(F.timestamp_seconds(F.unix_date("session").cast("long") * 86400 + minutes * 60), zone)
    close = F.when(F.array_contains(listed(early), F.col("session")), F.lit(closes_early)).otherwise(F.lit(closes))
    return trading.select("session", local(F.lit(opens)).alias("market_open"), local(close).alias("market_close"))


def calendar_of(security_type: Column, exchange: Column, codes: dict[str, str]) -> Column:
    """Calendar of an entity: crypto trades around the clock, an exchange by its code, else New York."""
    out = F.when(security_type == "CRYPTO", "24/7")
    for code, name in codes.items():
        out = out.when(exchange == code, name)
    return out.otherwise("XNYS")


def rebalance_times(schedule: DataFrame) -> DataFrame:
    """Daily rebalancing: the sessions' opens."""
    return schedule.select(F.col("market_open").alias("time_index"))


def portfolio_grid(schedule: DataFrame, end=None) -> DataFrame:
    """Daily portfolios: the sessions' closes up to ``end``."""
    out = schedule.select(F.col("market_close").alias("time_index"))
    return out if end is None else out.where(F.col("time_index") <= F.lit(end))


def fixed_grid(spark: SparkSession, start, end, step: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr(f"INTERVAL {step}"))).alias("time_index"))
