"""The bounded sample of labelled documents on which a classifier is fitted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, fold: int, out_at: int, most: int, seed: int, longest: int = 1 << 16) -> pd.DataFrame:
    """At most ``most`` labelled documents outside the held-out fold: doc_id, y, lang, text (bytes), sorted by doc_id.

    The ids are drawn by hash from the labels alone, so that only the drawn texts leave the scan. Rows with a null id
    or label don't count; of repeated ids the largest label and the least text are taken. Texts of more than ``longest``
    bytes aren't learned from, which bounds the sample in bytes as well; they are scored like any other.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod(fold) != out_at))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.select("doc_id", F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    drawn = texts.where(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
    drawn = drawn.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("text", "lang")).alias("least")).select("doc_id", "y", "least.lang", "least.text")
    return drawn.toPandas().sort_values("doc_id").reset_index(drop=True)
