"""Benchmark decontamination: prefix-filtered join of benchmark windows with documents.

A window is ``size`` consecutive words of an item (an item of fewer words is one window). Its tokens are its shingles of
``width`` words (fewer words: one shingle). One scan counts the benchmark's shingles over the corpus, which orders each
window's shingles by rarity. As a window counts only when it occurs whole (containment 1), its necessary prefix is its
rarest shingle, and a window with a shingle that no document has is out. A second scan yields the places of prefix
shingles; each proposes one start for the window, bounds on position and length drop those that can't fit, and the
window's words are compared with the text's, one by one.

Shingles are looked up by 64-bit hashes, which only propose; words decide. A scan keeps the places that pass a bitmap of
the hashes, 16 bits or more for each different one, up to MOST_SIEVE: 64 MB an executor, enough for 2^25 shingles. Beyond that more
places pass than the benchmark has, and results stay whole. What passes is joined by Spark, which moves the smaller side where
that is small (BROADCAST_ROWS) and shuffles both where it isn't. Items meet hits once those are verified, so that a window
of very many items is never one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, chunks, materialize, shingle_hashes, words

#: log2 of the bits of the bitmap that the scans carry, at least and at most.
SIEVE = 24
MOST_SIEVE = 29
#: Rows of prefixes, or digests of contaminated texts, that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, item), different pairs: windows as words with spaces between, and the ids, as strings, of items that have them."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column("item"), b.column("text"), strict=True):
                w = words(text.as_py())
                made = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)]
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in made], pa.string()), pa.array([item.as_py()] * len(made), pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "window string, item string").distinct()


def _shingles(held: DataFrame, width: int) -> DataFrame:
    """(window, length, width, offset, shingle) of every shingle of the windows."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for window, length in zip(b.column("window").to_pylist(), b.column("length").to_pylist(), strict=True):
                k = min(width, length)
                h = shingle_hashes(np.fromiter((hashes[x] for x in window.encode().split(b" ")), np.uint64, length), k)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([window] * n), pa.array([length] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(h.view(np.int64))], names=["window", "length", "width", "offset", "shingle"])

    return held.select("window", "length").mapInArrow(run, "window string, length int, width int, offset int, shingle long")


def _sieve(shingles: DataFrame) -> np.ndarray:
    """A bitmap of the hashes' first bits, as bytes: 2^(MOST_SIEVE - 15) rows of 4 kB at most."""
    n = shingles.select("shingle").distinct().count()
    bits = min(MOST_SIEVE, max(SIEVE, (16 * n).bit_length()))
    at = F.shiftrightunsigned("shingle", 64 - bits) + 1
    rows = shingles.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 :][:4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _places(docs: list[list[bytes]], hashes: WordHashes, sieve: np.ndarray, widths: list[int]) -> tuple[np.ndarray, ...]:
    """Where shingles stand that pass the sieve: text, position in it, width, hash; in order."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(size)
    h = np.fromiter((hashes[w] for d in docs for w in d), np.uint64, int(size.sum()))
    found = []
    for k in widths:
        s = shingle_hashes(h, k)
        at = (s >> np.uint64(65 - (8 * len(sieve)).bit_length())).astype(np.int64)
        at = np.flatnonzero(sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        of = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[of]
        at, of = at[inside], of[inside]
        found.append((of, at - (ends - size)[of], np.full(len(at), k), s[at]))
    out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def prefixes(documents: DataFrame, owned: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """(shingle, offset, window, length) of every window of owned that may occur, by its rarest shingle; and the widths in use."""
    held = owned.select("window").distinct().withColumn("length", F.size(F.split("window", " ")))
    parts = materialize(_shingles(held, width), "window-shingles")
    widths = sorted(r.width for r in parts.select("width").distinct().collect())  # at most ``width``
    sieve = documents.sparkSession.sparkContext.broadcast(_sieve(parts))

    def count(batches):
        hashes = WordHashes()
        for b in batches:
            for part in chunks((x.as_py() for x in b.column("text")), 2 << 20):
                found, n = np.unique(_places([words(t) for t in part], hashes, sieve.value, widths)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

    counts = documents.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, "hash long, n long")
    counts = counts.groupBy("hash").agg(F.sum("n").alias("n"))
    known = parts.join(counts, F.col("shingle") == F.col("hash"), "left")
    rarest = known.groupBy("window", "length").agg(F.min(F.struct("n", "shingle", "offset")).alias("p"), F.count(F.when(F.col("n").isNull(), 1)).alias("lost")).where("lost = 0")
    return materialize(rarest.select("p.shingle", "p.offset", "window", "length"), "prefixes"), widths


def _candidates(documents: DataFrame, prefix: DataFrame, widths: list[int], size: int, *columns: str | Column) -> DataFrame:
    """columns, digest (of texts with a candidate), n_words, places (array of pos, shingle, at, near) for every row of documents.

    near: the words around the place, as far as a window that has it may reach; at: the place in them.
    """
    sieve = documents.sparkSession.sparkContext.broadcast(_sieve(prefix))
    place = pa.list_(pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("near", pa.string())]))
    wide = max(widths, default=0)
    rows = documents.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            n_words, digests, places = [], [], []
            for part in chunks((x.as_py() for x in b.column("text")), 2 << 20):
                docs = [words(t) for t in part]
                held: list[list] = [[] for _ in docs]
                for of, pos, k, h in zip(*(x.tolist() for x in _places(docs, hashes, sieve.value, widths)), strict=True):
                    # a shingle of fewer words than ``width`` is its window
                    lo, hi = (max(0, pos - size + k), pos + size) if k == wide else (pos, pos + k)
                    held[of].append({"pos": pos, "shingle": h - (h >> 63 << 64), "at": pos - lo, "near": b" ".join(docs[of][lo:hi]).decode()})
                n_words += map(len, docs)
                places += held
                digests += [hashlib.sha256(t).hexdigest() if p else None for t, p in zip(part, held, strict=True)]
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.string()), pa.array(n_words, pa.int64()), pa.array(places, place)], names=[*b.schema.names[:-1], "digest", "n_words", "places"])

    before = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{before}digest string, n_words long, places array<struct<pos:int,shingle:long,at:int,near:string>>")


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast where its rows are few enough; else the join is left to Spark, which shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _verified(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """The candidates of found (with a struct ``p``) at which the window stands, with window, start and end."""
    held = _checked(prefix.withColumnRenamed("shingle", "key"))
    met = found.join(held, F.col("p.shingle") == F.col("key"))
    start = F.col("p.pos") - F.col("offset")
    met = met.where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("p.near", " "), F.col("p.at") - F.col("offset") + 1, F.col("length")), " ") == F.col("window")
    # bounds first: a slice may not begin before the array
    fits = (F.col("p.at") >= F.col("offset")) & F.when(F.col("p.at") >= F.col("offset"), same).otherwise(False)
    return met.where(fits).withColumns({"start": start.cast("long"), "end": (start + F.col("length")).cast("long")})


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, size: int = 10, width: int = 5) -> DataFrame:
    """Every row of documents with doc_id, row, n_words, hit (runs of hit words: start, end), items (ids as strings, distinct).

    row numbers the rows, so that repeated or null ids stay apart. Two scans of the texts at any size of the benchmark.
    Null texts and items have no words; an empty benchmark hits nothing; an item with a null id hits words like any other,
    but can't be named among the items; equal items count each; ids may be of any type; other columns are ignored; an
    empty table gives none.
    """
    owned = materialize(windows(benchmark, size), "windows")
    prefix, widths = prefixes(documents, owned, width)
    rows = _candidates(documents, prefix, widths, size, "doc_id").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.drop("digest"), "benchmark-places")
    met = _verified(rows.select("row", "n_words", F.explode("places").alias("p")), prefix)
    # a text may hold a window many times
    met = materialize(met.groupBy(F.col("row").alias("at"), "window").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "benchmark-hits")
    runs = met.groupBy("at").agg(F.flatten(F.collect_list("runs")).alias("runs")).select("at", union_runs("runs").alias("runs"))
    named = _checked(owned.where("item IS NOT NULL").withColumnRenamed("window", "of"))
    items = met.select("at", "window").join(named, F.col("window") == F.col("of")).groupBy(F.col("at").alias("who")).agg(F.collect_set("item").alias("items"))
    out = rows.drop("places").join(runs, F.col("row") == F.col("at"), "left").join(items, F.col("row") == F.col("who"), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "row", "n_words", F.coalesce("runs", none).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def union_runs(column: str) -> Column:
    """Merges overlapping or touching runs."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(
        F.array_sort(column),
        start,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, width: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents; cases as in benchmark_hits."""
    hits = benchmark_hits(documents, benchmark, size, width)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort("items"), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 10, width: int = 5) -> DataFrame:
    """The rows of documents in which no benchmark window occurs, with all their columns; cases as in benchmark_hits.

    Whether a text is contaminated is a matter of the text alone, so the rows that go are known by its SHA-256: null and
    repeated ids don't matter.
    """
    prefix, widths = prefixes(documents, materialize(windows(benchmark, size), "windows"), width)
    found = _candidates(documents, prefix, widths, size).where(F.size("places") > 0)
    found = materialize(found, "benchmark-places").select("digest", "n_words", F.explode("places").alias("p"))
    bad = materialize(_verified(found, prefix).select("digest").distinct(), "contaminated-texts")
    return documents.join(_checked(bad), F.sha2(documents["text"].cast("string").cast("binary"), 256) == bad["digest"], "left_anti")
