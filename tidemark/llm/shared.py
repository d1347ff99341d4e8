"""Helpers that the operators share: words, intermediate tables, union-find and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 class of the bytes between two words: ASCII that is neither a digit nor a letter a-z.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
SPACE = r"[\x20\x09-\x0D]"

#: Different words whose hashes a task keeps.
KEPT_WORDS = 1 << 18
_P = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate: lower-cases A-Z and turns every byte that is no part of a word into a space.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text with A-Z lower-cased; null has none."""
    return text.translate(_WORD_TABLE).split() if text else []


def word_pieces(text: bytes | None, most: int = 1 << 22):
    """The words of the text, in lists of those in about ``most`` bytes each, so that no list holds a very long text."""
    low, at = text.translate(_WORD_TABLE) if text else b"", 0
    while at < len(low):
        end = low.find(b" ", at + most)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def tokens(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words from the words' hashes; order counts, as does the width."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * _P[0] + h[k : k + n]
        out ^= out >> np.uint64(32)
        out *= _P[1]
        out ^= out >> np.uint64(29)
    return out * _P[2]


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. The regex guard spares texts without capitals the slow path."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master uses a folder of its own; a cluster, whose machines share no such folder, raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads it: one pass, no lineage, safe when executors are lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, when nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        folder = next(iter(t.inputFiles()), "").rpartition("/")[0]
        if shared_dir(spark).partition(":")[2].strip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, an execution's shuffle files go when it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Bits of a sieve: for each key, and the binary logarithm of the most of all (16 MB). With more keys than these hold more rows pass.
SIEVE_BITS, SIEVE_LOG = 32, 27


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys, and by chance few others; rows stay where they are.

    A bitmap of the keys' hashes is broadcast, in pieces of 32,768 bits. keys should be a table, as it is read twice.
    """
    log = max(20, min(SIEVE_LOG, (SIEVE_BITS * keys.count()).bit_length()))
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << log) - 1))
    places = keys.select(at(key).alias("place")).select(F.shiftright("place", 15).alias("piece"), F.col("place").bitwiseAND(F.lit(32767)).alias("bit"))
    # dealt first, as parts of bitmaps are as large as whole ones
    bitmaps = places.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    bit = at(column).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bitmaps), F.shiftright(at(column), 15) == F.col("piece")).where(there).select(*rows.columns)


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of x; paths are halved on the way."""
    while True:
        p = parent[x]
        g = parent[p]
        if np.array_equal(p, g):
            return p
        parent[x] = g
        x = g


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; the smallest index of a set is its root."""
    while len(a):
        ra, rb = find(parent, a), find(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every id that has an edge.

    edges: (a long, b long), in either direction, repeats and loops allowed, nulls dropped. Returns (id, component_id).
    Every round takes the smallest label among neighbours, then follows the label's own label (pointer jumping), so
    a chain of n links needs about log n rounds. Labels and edges stay distributed; each round is written to the
    shared folder. A hub with very many edges is pre-aggregated by min before its shuffle.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.a == labels.id).groupBy("b").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.b).select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("next"))
        step = step.join(jump, step.new == jump["at"], "left").select("id", F.least("new", F.coalesce("next", "new")).alias("label"), (F.least("new", F.coalesce("next", "new")) != F.col("label")).alias("moved"))
        step = materialize(step, "labels")
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component_id"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def text_bytes(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns and ``text`` as UTF-8 bytes, which Arrow hands to Python without decoding."""
    return df.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def chunks(items: Iterable[bytes | None], most: int):
    """Groups of neighbouring texts of about ``most`` bytes in all; a longer text is a group of its own."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x or b"")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
