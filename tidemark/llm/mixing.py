"""Mixing sources to target weights: hash-random keys, range-sorted within each source, distributed prefix sums of
sizes, and a cut at each source's exact budget, whole epochs first. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialize

#: A source of n documents has its keys cut into sqrt(n) / RANGE_PART ranges, so that both the rows of a range and the
#: ranges of a source, which meet in one task each, grow with the square root only.
RANGE_PART = 8.0
def n_tokens(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    gaps = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"(?:\x20?[\x09-\x0D]\x20?|\x20\x20){SPACE}*", " "))
    return F.when(gaps == "", 0).otherwise(F.length(gaps) - F.length(F.replace(gaps, F.lit(" "))) + 1).cast("long")


def cycle(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the sources' rank from 1."""
    return (1 + F.pmod(rank - 1, F.lit(3))).cast("double")


def _in_order(df: DataFrame, tag: str, *order: Column) -> DataFrame:
    """The rows, written, with part and place: ranges of the order, and the order within them. No range is the whole table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), tag)


def _before(df: DataFrame, **sums: Column) -> DataFrame:
    """Adds, of each named column, the sum over all rows before: sums of whole ranges, and running sums within a range."""
    parts = df.groupBy(F.col("part").alias("p")).agg(*(F.sum(c).alias(f"in_{k}") for k, c in sums.items()))
    # one row a range
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("p", *(F.coalesce(F.sum(f"in_{k}").over(earlier), F.lit(0)).alias(f"in_{k}") for k in sums))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    return out.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumns({k: F.col(k) + F.col(f"in_{k}") for k in sums}).drop("p", *(f"in_{k}" for k in sums))


def targets(sizes: DataFrame, weight: Callable[[Column], Column] = cycle, epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """Adds target to (source, source_size): ``share`` of all sizes, dealt by weight and capped at ``epochs`` times a source's size.

    Sources rank by code point, null last. The caps' excess goes to the others by weight. Sources that are capped are
    those of the least source_size / weight, so one pass over the sources in that order finds them: a source is capped
    when an even deal of what is left, over the weights left, would exceed its cap. Both orders are ranges with prefix
    sums, so that sources may be as many as documents.
    """
    by_name = (F.col("source").isNull(), F.col("source"))
    ranked = _before(_in_order(sizes, "sources-by-name", *by_name), rank=F.lit(1).cast("long")).drop("part", "place")
    ranked = ranked.withColumn("weight", weight(F.col("rank") + 1)).drop("rank")
    ranked = _in_order(ranked, "sources-by-room", F.col("source_size") / F.col("weight"), *by_name)
    cap = F.col("source_size") * F.lit(float(epochs))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_sizes"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("all_weights"))
    dealt = _before(ranked, caps=cap, weights=F.col("weight")).crossJoin(F.broadcast(total))
    dealt = dealt.withColumn("rate", (F.col("all_sizes") * F.lit(float(share)) - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    # the first source that is not full fixes the rate of all from it on
    dealt = dealt.withColumn("full", cap <= F.col("rate") * F.col("weight"))
    first = dealt.where(~F.col("full")).agg(F.min(F.struct("place", "rate")).alias("first")).select(F.col("first.place").alias("from_place"), F.col("first.rate").alias("final"))
    dealt = dealt.crossJoin(F.broadcast(first))
    rate = F.when(F.col("place") >= F.col("from_place"), F.col("final"))
    return dealt.select(*sizes.columns, F.coalesce(F.least(cap, rate * F.col("weight")), cap).alias("target"))


def mix(documents: DataFrame, weight: Callable[[Column], Column] = cycle, epochs: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of documents.

    Every source is taken whole as often as its target allows; the rest is cut from its documents in the order of
    their hash keys, the last one in part, so that the words taken are the target's whole number. The key is a hash of
    seed, doc_id and text: reruns agree, and rows of one id, or of none, are spread; equal rows go in any order. A null
    text has size 0, a null source is a source of its own, null ids are like any other; an empty table gives no rows.

    Only one pass reads texts; what is sorted is (source, key, size). A source's keys are cut into even
    ranges, each of which is summed and sorted by itself, so that no source meets in one task; offsets of the
    ranges come from their sums. The ranking of the sources and their caps follow orders over all sources, which are ranges with prefix
    sums as well: no table passes through one task.
    """
    kind = documents.schema["doc_id"].dataType
    text_md5 = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_md5).cast("binary"))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("size"), key.alias("key"))
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, weight, epochs, share)
    sources = sources.withColumn("cut", F.ceil(F.sqrt("n") / RANGE_PART)).select(F.col("source").alias("s"), "source_size", "target", "cut")
    sources = materialize(sources, "sources")
    held = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # keys are even over 60 bits, so equal steps are ranges of about as many rows
    range_of = F.least(F.floor(F.col("key") / F.lit(2.0**60) * F.col("cut")), F.col("cut") - 1).cast("long")
    held = held.withColumn("range", range_of)
    sums = held.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    prior = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), prior.alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    words = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return held.select(F.col("doc_id").cast(kind), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
