"""Filling along time: forward and backward fill, dense panels, as-of joins.

An as-of join is a union of both sides and one window: a merge by key and time, never a Cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def bfill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    # backwards in time: a frame up to the end would be gone through again for every row
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def dense(df: DataFrame, grid: DataFrame, entities: DataFrame, keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """Every entity at every time of the grid, with nulls where the panel has no row. The entities are a dimension table."""
    cells = grid.select(time).distinct().crossJoin(entities.select(*keys).distinct())
    return cells.join(df, [time, *keys], "left").select(*df.columns)


def dense_ffill(df: DataFrame, grid: DataFrame, entities: DataFrame, columns: Sequence[str], ahead: Sequence[str] = (), keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """Every entity at every time of the grid with the last known values; columns in ``ahead``, copies, also have a key's first value before that.

    The panel's rows are set among the grid's cells, so that one shuffle and one sort serve the grid and both fills. Rows of df
    whose time isn't on the grid count for the cells after it.
    """
    cells = grid.select(time).distinct().crossJoin(entities.select(*keys).distinct()).withColumn("_cell", F.lit(1))
    both = df.select(time, *keys, *columns, F.lit(0).alias("_cell")).unionByName(cells, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_cell")
    so_far, all_rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {f"_f {c}": F.last(c, ignorenulls=True).over(so_far) for c in columns} | {f"_b {c}": F.first(c, ignorenulls=True).over(all_rows) for c in ahead}
    both = both.withColumns(made).where("_cell = 1")
    return both.select(time, *keys, *(F.col(f"_f {c}").alias(c) for c in columns), *(F.coalesce(f"_f {c}", f"_b {c}").alias(f"{c}_ahead") for c in ahead))


def asof(grid: DataFrame, data: DataFrame, columns: Sequence[str], keys: Sequence[str] = (KEY,), time: str = TIME, tolerance: str | None = None, source_time: str | None = None, skip_null: bool = True) -> DataFrame:
    """The grid's rows with the last values of data at or before their time, by key.

    tolerance (an interval as SQL text): a value counts only while less than that has passed since it was set; at the
    bound itself it is null. source_time names a column for the time at which the row's values were set. skip_null
    takes each column's last value, else the columns of the last row as they are.
    """
    extra = [c for c in grid.columns if c not in keys and c != time]
    left = grid.select(*keys, time, F.lit(1).alias("_side"), *(F.col(c).alias(f"_g_{c}") for c in extra), *(F.lit(None).cast(data.schema[c].dataType).alias(c) for c in columns), F.lit(None).cast(data.schema[time].dataType).alias("_set"))
    right = data.select(*keys, time, F.lit(0).alias("_side"), *(F.lit(None).cast(grid.schema[c].dataType).alias(f"_g_{c}") for c in extra), *columns, F.col(time).alias("_set"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right)
    if skip_null:
        both = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in (*columns, "_set")})
    else:
        row = F.last(F.when(F.col("_side") == 0, F.struct(*columns, "_set")), ignorenulls=True).over(w)
        both = both.withColumn("_row", row).withColumns({c: F.col(f"_row.{c}") for c in (*columns, "_set")})
    out = both.where("_side = 1")
    if tolerance:
        fresh = F.col(time) < F.col("_set") + F.expr(f"INTERVAL {tolerance}")
        out = out.withColumns({c: F.when(fresh, F.col(c)) for c in columns})
    made = [F.col("_set").alias(source_time)] if source_time else []
    return out.select(*keys, time, *(F.col(f"_g_{c}").alias(c) for c in extra), *columns, *made)


def resample_last(df: DataFrame, step: str, columns: Sequence[str], keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """Last values of each fixed step, labelled by its start, and filled forward over steps without rows.

    Steps exist from a key's first to its last; each is made from the key's bounds, so the grid never leaves the cluster.
    """
    stepped = df.withColumn("_step", F.window(time, step)["start"]).groupBy(*keys, "_step").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns))
    grid = stepped.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    grid = grid.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias("_step"))
    full = grid.join(stepped, [*keys, "_step"], "left").withColumnRenamed("_step", time)
    return ffill(full, columns, keys, time)


def weekly_last(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (KEY,), time: str = TIME) -> DataFrame:
    """Last known values of each week that ends on a Sunday, labelled by that Sunday."""
    sunday = F.date_add(F.date_trunc("week", time).cast("date"), 6).cast(df.schema[time].dataType)
    made = df.groupBy(*keys, sunday.alias("_week")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns))
    return made.withColumnRenamed("_week", time)
