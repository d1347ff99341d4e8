"""Entities: a table with filters by name, as in an object client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_TESTS = {
    "in": lambda c, v: c.isin(list(v)), "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
    "contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def condition(**filters) -> Column:
    """field=value, field__in=[...], field__gte=..., nested__field=...; all must hold."""
    out = F.lit(True)
    for name, value in filters.items():
        parts = name.split("__")
        test = _TESTS[parts.pop()] if parts[-1] in _TESTS else None
        c = F.col(".".join(f"`{p}`" for p in parts))
        out = out & (test(c, value) if test else c.eqNullSafe(F.lit(value)))
    return out


def filtered(entities: DataFrame, **filters) -> DataFrame:
    return entities.where(condition(**filters))


def get(entities: DataFrame, **filters) -> Row:
    """The one entity that meets the filters; none or several raise."""
    found = filtered(entities, **filters).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} entity for {filters}")
    return found[0]


def current(snapshots: DataFrame) -> DataFrame:
    """Snapshots that are still valid."""
    return snapshots.where("effective_to IS NULL")


def as_of(snapshots: DataFrame, at) -> DataFrame:
    """Snapshots valid at a time: effective_from <= at < effective_to."""
    return snapshots.where((F.col("effective_from") <= F.lit(at)) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.lit(at))))


def in_category(entities: DataFrame, members: DataFrame, category: str, key: str = "unique_identifier") -> DataFrame:
    """Entities of a named set; members has category and the key."""
    m = members.where(F.col("category") == category).select(F.col(key).alias("_k"))
    return entities.join(m, F.col(key) == F.col("_k"), "left_semi")
