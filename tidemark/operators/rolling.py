"""Order-dependent functions by key: lags, returns, rolling statistics, ranks.

They are columns over windows, so that several of one partitioning share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY, TIME, by_key


def rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, the current one included."""
    return (w if w is not None else by_key()).rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec | None = None) -> WindowSpec:
    return (w if w is not None else by_key()).rowsBetween(Window.unboundedPreceding, 0)


def simple_return(p: Column, w: WindowSpec | None = None) -> Column:
    """p / previous p - 1; null and infinite become 0."""
    prev = F.lag(p).over(w if w is not None else by_key())
    return F.coalesce(F.when(prev != 0, p / prev - 1), F.lit(0.0))


def padded_return(p: Column, w: WindowSpec | None = None) -> Column:
    """Change against the last known value before, the current one filled forward as well."""
    w = w if w is not None else by_key()
    filled = F.last(p, ignorenulls=True).over(so_far(w))
    prev = F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(prev != 0, filled / prev - 1)


def next_return(p: Column, w: WindowSpec | None = None) -> Column:
    """The return that the key's next row brings."""
    nxt = F.lead(p).over(w if w is not None else by_key())
    return F.when(p != 0, nxt / p - 1)


def log_return(p: Column, w: WindowSpec | None = None) -> Column:
    prev = F.lag(p).over(w if w is not None else by_key())
    return F.when((p > 0) & (prev > 0), F.log(p) - F.log(prev))


def nav(r: Column, start: Column | float = 1.0, w: WindowSpec | None = None) -> Column:
    """start times the running product of 1 + r."""
    start = F.lit(start) if isinstance(start, float) else start
    return start * F.product(1 + r).over(so_far(w))


def rolling_median(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Median of the non-null values among the last n rows, from one value on."""
    return F.percentile(x, F.lit(0.5)).over(rows(n, w))


def rolling_mean(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.avg(x).over(rows(n, w))


def rolling_std(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Sample deviation; null until all of the last n rows have a value."""
    frame = rows(n, w)
    return F.when(F.count(x).over(frame) == n, F.stddev_samp(x).over(frame))


def realized_volatility(p: Column, n: int = 20, periods: float = 6048.0, w: WindowSpec | None = None) -> Column:
    """Deviation of padded returns, annualised. p must hold a padded return column when nested windows are refused."""
    return rolling_std(p, n, w) * F.sqrt(F.lit(periods))


def average_rank(x: Column, by: Column | str = TIME, descending: bool = True) -> Column:
    """Rank within ``by``, ties sharing their mean rank; nulls have none and count for none."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    ranked = Window.partitionBy(by).orderBy(order)
    ties = F.count(F.lit(1)).over(ranked.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(ranked) + (ties - 1) / 2)


def rebased(p: Column, base: float = 100.0, w: WindowSpec | None = None) -> Column:
    """p relative to the key's first row."""
    first = F.first(p).over(so_far(w))
    return F.when(first != 0, p / first * base)


def ewm_std(x: Column, span: float, w: WindowSpec | None = None, memory: int | None = None) -> Column:
    """Bias-corrected deviation with exponential weights (no adjustment): the newest row weighs a = 2 / (span + 1), older ones
    a (1 - a)^j, the very first (1 - a)^t. Rows beyond ``memory`` (default: weight below 1e-15) count as the first one,
    which bounds the array that a row gathers. Null in the key's first row.
    """
    a = 2.0 / (span + 1.0)
    if memory is None:
        import math

        memory = max(2, math.ceil(math.log(1e-15) / math.log(1 - a))) if a < 1 else 2
    values = F.collect_list(F.coalesce(x.cast("double"), F.lit(float("nan")))).over(rows(memory, w))
    n = F.size(values)
    weight = lambda i: F.when(i == 0, F.pow(F.lit(1 - a), n - 1)).otherwise(a * F.pow(F.lit(1 - a), n - 1 - i))
    terms = F.transform(values, lambda v, i: F.struct(weight(i).alias("w"), v.alias("x")))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("w2", "wx", "wxx")))
    sums = F.aggregate(terms, zero, lambda acc, t: F.struct((acc["w2"] + t["w"] * t["w"]).alias("w2"), (acc["wx"] + t["w"] * t["x"]).alias("wx"), (acc["wxx"] + t["w"] * t["x"] * t["x"]).alias("wxx")), lambda acc: F.when(acc["w2"] < 1, F.sqrt(F.greatest(F.lit(0.0), (acc["wxx"] - acc["wx"] * acc["wx"]) / (1 - acc["w2"])))))
    return F.when(n > 1, sums)


def rolling_ols(df: DataFrame, y: str, x: str, n: int, w: WindowSpec | None = None) -> DataFrame:
    """Adds beta, intercept, r_squared, t_beta, t_intercept of y on one factor and an intercept over the last n rows; null until n
    rows have both and the factor varies.

    The residual variance divides by n - 1 (n - k + 1 with k = 2 parameters), as in the analytics this follows. The
    moments are columns of their own, as Spark would evaluate a window again wherever an expression repeats it.
    """
    frame = rows(n, w)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    moments = {"_n": F.count(a), "_mx": F.avg(a), "_my": F.avg(b), "_vx": F.var_pop(a), "_vy": F.var_pop(b), "_cov": F.covar_pop(b, a)}
    out = df.withColumns({k: m.over(frame) for k, m in moments.items()})
    ok = (F.col("_n") == n) & (F.col("_vx") > 0)
    out = out.withColumn("beta", F.when(ok, F.col("_cov") / F.col("_vx")))
    out = out.withColumn("_s2", F.greatest(n * (F.col("_vy") - F.col("beta") * F.col("_cov")), F.lit(0.0)) / (n - 1))
    out = out.withColumns({
        "intercept": F.col("_my") - F.col("beta") * F.col("_mx"),
        "r_squared": F.when(ok, F.when(F.col("_vy") > 0, F.col("_cov") * F.col("_cov") / (F.col("_vx") * F.col("_vy"))).otherwise(1.0)),
        "t_beta": F.when(F.col("_s2") > 0, F.col("beta") / F.sqrt(F.col("_s2") / (n * F.col("_vx")))),
    })
    spread = F.sqrt(F.col("_s2") * (1 / F.lit(float(n)) + F.col("_mx") * F.col("_mx") / (n * F.col("_vx"))))
    return out.withColumn("t_intercept", F.when(F.col("_s2") > 0, F.col("intercept") / spread)).drop(*moments, "_s2")


def sma(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    frame = rows(n, w)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def ema(x: Column, n: int, w: WindowSpec | None = None, memory: int | None = None) -> Column:
    """Recursive mean with a = 2 / (n + 1) from the key's first row; bounded memory as in ewm_std."""
    import math

    a = 2.0 / (n + 1.0)
    memory = memory or (max(2, math.ceil(math.log(1e-15) / math.log(1 - a))) if a < 1 else 2)
    values = F.collect_list(x.cast("double")).over(rows(memory, w))
    size = F.size(values)
    return F.aggregate(F.transform(values, lambda v, i: v * F.when(i == 0, F.pow(F.lit(1 - a), size - 1)).otherwise(a * F.pow(F.lit(1 - a), size - 1 - i))), F.lit(0.0), lambda s, v: s + v)


def rsi(change: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Relative strength index over simple means of gains and losses of the last n changes."""
    frame = rows(n, w)
    up, down = F.avg(F.greatest(change, F.lit(0.0))).over(frame), F.avg(F.greatest(-change, F.lit(0.0))).over(frame)
    return F.when(F.count(change).over(frame) == n, F.when(up + down > 0, 100 * up / (up + down)).otherwise(50.0))


def wma(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Mean with weights 1 to n, the newest the heaviest; null until n values."""
    frame = rows(n, w)
    values = F.collect_list(x.cast("double")).over(frame)
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.count(x).over(frame) == n, total / (n * (n + 1) / 2))


def momentum(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """x less its value n rows before."""
    return x - F.lag(x, n).over(w if w is not None else by_key())


def rate_of_change(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Change against n rows before, in percent."""
    before = F.lag(x, n).over(w if w is not None else by_key())
    return F.when(before != 0, 100 * (x / before - 1))


def z_score(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Distance from the mean of the last n values in sample deviations."""
    sd = rolling_std(x, n, w)
    return F.when(sd > 0, (x - F.avg(x).over(rows(n, w))) / sd)


def percent_b(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Place of x between the bands two population deviations around the mean of the last n values."""
    frame = rows(n, w)
    sd = F.stddev_pop(x).over(frame)
    return F.when((F.count(x).over(frame) == n) & (sd > 0), (x - F.avg(x).over(frame)) / (4 * sd) + 0.5)


def stochastic(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Place of x between the least and the largest of the last n values, in percent."""
    frame = rows(n, w)
    lo, hi = F.min(x).over(frame), F.max(x).over(frame)
    return F.when(F.count(x).over(frame) == n, F.when(hi > lo, 100 * (x - lo) / (hi - lo)).otherwise(50.0))


def macd(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Exponential mean of n rows less that of 26 / 12 as many."""
    return ema(x, n, w) - ema(x, round(n * 26 / 12), w)


INDICATORS = {"SMA": sma, "EMA": ema, "RSI": rsi, "WMA": wma, "MOM": momentum, "ROC": rate_of_change, "ZSCORE": z_score, "BBP": percent_b, "STOCH": stochastic, "MACD": macd, "STDEV": rolling_std, "MEDIAN": rolling_median}


def indicators(df: DataFrame, configs: list[dict], price: str = "close", key: str = KEY, time: str = TIME) -> DataFrame:
    """One column for each config {"name", "length"}, named by feature_name(config)."""
    from ..functions.scalar import feature_name

    from .passes import exponential

    spans = {feature_name(c): int(c["length"]) for c in configs if c["name"] in ("EMA", "MACD")}
    slow = {n: f"_slow {i}" for i, n in enumerate(feature_name(c) for c in configs if c["name"] == "MACD")}
    if spans:
        x = F.col(price)
        df = exponential(df, {n: ("mean", x, k) for n, k in spans.items()} | {s: ("mean", x, round(spans[n] * 26 / 12)) for n, s in slow.items()}, (key,), time)
        df = df.withColumns({n: F.col(f"`{n}`") - F.col(f"`{s}`") for n, s in slow.items()}).drop(*slow.values())
    w = Window.partitionBy(key).orderBy(time)
    df = df.withColumn("_change", F.col(price) - F.lag(price).over(w))
    made = {}
    for c in configs:
        if feature_name(c) in spans:
            continue
        source = F.col("_change") if c["name"] == "RSI" else F.col(price)
        made[feature_name(c)] = INDICATORS[c["name"]](source, int(c["length"]), w)
    return df.withColumns(made).drop("_change")
