"""Scalar functions: frequencies, finance, JSON and names."""

from __future__ import annotations

import base64
import gzip
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "mo": "MONTH", "q": "MONTH", "y": "YEAR"}


def interval(frequency: str) -> str:
    """SQL interval of a frequency such as 1m, 5m, 1d, 1w, 1mo, 1q, 1y."""
    m = re.fullmatch(r"(\d+)(mo|[mhdwqy])", frequency)
    if not m:
        raise ValueError(f"no frequency: {frequency}")
    n = int(m[1]) * (3 if m[2] == "q" else 1)
    return f"{n} {_UNITS[m[2]]}"


def minutes(frequency: str) -> int:
    """Whole minutes of a frequency of minutes, hours, days or weeks."""
    n, unit = interval(frequency).split()
    each = {"MINUTE": 1, "HOUR": 60, "DAY": 1440, "WEEK": 10080}
    if unit not in each:
        raise ValueError(f"{frequency} has no fixed length")
    return int(n) * each[unit]


def discount_factor(zero: Column, days: Column) -> Column:
    """Simple rate, ACT/360; a rate above 1 is in percent."""
    z = F.when(zero > 1, zero / 100).otherwise(zero)
    return 1 / (1 + z * days / F.lit(360.0))


def forward_rate(df0: Column, df1: Column, years: Column) -> Column:
    return F.when(years > 0, (df0 / df1 - 1) / years)


def annuity(weights: Column, factors: Column) -> Column:
    """Aggregate: sum of accruals times discount factors."""
    return F.sum(weights * factors)


def par_rate(first: Column, last: Column, annuity_value: Column) -> Column:
    return F.when(annuity_value != 0, (first - last) / annuity_value)


def year_fraction(start: Column, end: Column, basis: str = "ACT/360") -> Column:
    days = F.datediff(end, start)
    if basis == "ACT/360":
        return days / F.lit(360.0)
    if basis == "ACT/365F":
        return days / F.lit(365.0)
    if basis == "30/360":
        d1 = F.least(F.dayofmonth(start), F.lit(30))
        d2 = F.when((F.dayofmonth(end) == 31) & (d1 == 30), 30).otherwise(F.dayofmonth(end))
        return (360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + d2 - d1) / F.lit(360.0)
    raise ValueError(f"no day count: {basis}")


def adjusted(day: Column, rule: str = "FOLLOWING") -> Column:
    """Business-day adjustment on weekdays; MODIFIED keeps the month."""
    wd = F.weekday(day)
    later = F.date_add(day, F.when(wd == 5, 2).when(wd == 6, 1).otherwise(0))
    earlier = F.date_sub(day, F.when(wd == 5, 1).when(wd == 6, 2).otherwise(0))
    if rule == "FOLLOWING":
        return later
    if rule == "PRECEDING":
        return earlier
    if rule == "MODIFIED":
        return F.when(F.month(later) == F.month(day), later).otherwise(earlier)
    if rule == "UNADJUSTED":
        return day
    raise ValueError(f"no rule: {rule}")


def feature_name(config: dict) -> str:
    """Column name of a config: f_ and url-safe base64 of its canonical JSON, padding stripped."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return "f_" + base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def feature_config(name: str) -> dict:
    body = name.removeprefix("f_")
    return json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))


@F.pandas_udf(T.MapType(T.IntegerType(), T.DoubleType()))
def curve_nodes(cells: pd.Series) -> pd.Series:
    """Decodes base64(gzip(JSON {days: rate})) cells; Spark has no gzip function."""
    return cells.map(lambda c: None if c is None else {int(k): float(v) for k, v in json.loads(gzip.decompress(base64.b64decode(c))).items()})


@F.pandas_udf(T.StringType())
def curve_cell(nodes: pd.Series) -> pd.Series:
    """Encodes days -> rate maps; the inverse of curve_nodes."""
    return nodes.map(lambda m: None if m is None else base64.b64encode(gzip.compress(json.dumps({str(k): v for k, v in sorted(dict(m).items())}).encode(), mtime=0)).decode())


#: Rational approximation of the normal distribution function by Hart (1968), highest power first. Fixed values.
HART_ABOVE = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as an expression, to 1e-14: Spark has no erf."""

    def upper(a: Column) -> Column:
        """1 - cdf(a) for a >= 0."""
        poly = lambda c: reduce(lambda acc, k: acc * a + k, c[1:], F.lit(c[0]))
        far = reduce(lambda acc, k: a + k / acc, (4.0, 3.0, 2.0, 1.0), a + 0.65)
        tail = F.exp(-a * a / 2)
        return F.when(a > 37, 0.0).when(a < 7.07106781186547, tail * poly(HART_ABOVE) / poly(HART_BELOW)).otherwise(tail / (far * 2.506628274631))

    # the array names the value, so that it is computed once
    return F.get(F.transform(F.array(x.cast("double")), lambda v: F.when(v > 0, 1 - upper(F.abs(v))).otherwise(upper(F.abs(v)))), 0)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793))


def epoch_unit(n_digits: Column) -> Column:
    """Unit of epochs from the number of their digits: ns, us, ms, s, else min."""
    return F.when(n_digits >= 18, "ns").when(n_digits >= 15, "us").when(n_digits >= 12, "ms").when(n_digits >= 10, "s").otherwise("min")
