"""Line dedup: lines are exploded to hashes of their normal form, documents are counted for each hash, hashes over the
threshold lose their lines everywhere but in one document, and texts are put together again from the lines that stay, by position.

Only hashes are shuffled for the counts: 128 bits a line, so that a chance collision among 10^13 lines has a probability of
about 10^-13. Texts move once, to meet the hashes that their document loses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

#: Stripped at both ends of a line: [\x20\x09-\x0D].
BLANK = b" \t\n\x0b\x0c\r"
#: Lines of which a task holds the hashes at once.
HELD = 1 << 16


def key_hash(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key, the line stripped and with A-Z lower-cased; None for keys under ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(text: bytes | None, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The lines of a text, in lists of those in about ``most`` bytes each; null or empty: one empty line."""
    text, at = text or b"", 0
    while True:
        end = text.find(b"\n", at + most)
        if end < 0:
            yield text[at:].split(b"\n")
            return
        yield text[at:end].split(b"\n")
        at = end + 1


def line_keys(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2) for every different key of at least ``least`` code points of every row: the two halves of its hash."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            rows, held, last = [], [], 0
            for i in range(b.num_rows):
                mine = {h for part in _lines(text[i].as_py()) for x in part if (h := key_hash(x, least)) is not None}
                held += mine
                rows.append(len(mine))
                if len(held) >= HELD:
                    yield batch(ids.slice(last, i + 1 - last), rows, held)
                    rows, held, last = [], [], i + 1
            yield batch(ids.slice(last), rows, held)

    def batch(ids, rows, held):
        h = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(rows)), rows))), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "h1", "h2"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return documents.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, h1 long, h2 long")


def repeated_keys(keys: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, keeper): keys found in at least so many different documents, and the largest doc_id that holds each.

    Pairs of key and document are made different first, dealt by both, so that the rows of a very common key are spread; the
    counts are then summed where they are before they meet. Rows without an id are one document, smaller than all others.
    """
    pairs = keys.distinct()
    found = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n") >= documents).select("h1", "h2", "keeper")


def dedup_lines(documents: DataFrame, least: int = 20, documents_at_least: int = 3) -> DataFrame:
    """The documents with their text less its repeated lines, and n_lines (before), n_dropped.

    A key (the line stripped of blanks, A-Z lower-cased) of at least ``least`` code points that is found in at least
    ``documents_at_least`` different documents loses all its lines but those of the largest doc_id that holds it, repeats
    there included. The other lines stay as they are, in their order, joined by line feeds. A null text counts as empty: one
    empty line, and the text becomes empty. Rows of one id lose the same keys; rows whose id is null are one document
    together, smaller than any other. Texts of any length are read in parts of some megabytes; a task holds the different
    keys of one text (16 bytes each). Other columns are kept, those called n_lines and n_dropped are replaced; an empty
    table gives none.
    """
    keys = materialize(line_keys(documents, least), "line-keys")
    many = materialize(repeated_keys(keys, documents_at_least), "repeated-lines").select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "keeper")
    # a very common key's rows are split by Spark's skew join; what is repeated is on the side that stays whole
    lost = keys.join(many, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost")).select("lost_id", F.col("lost.h1").alias("l1"), F.col("lost.h2").alias("l2"))

    fields = [f for f in documents.schema.fields if f.name not in ("n_lines", "n_dropped")]
    names = [f.name for f in fields]
    plain = documents.select(*(F.col("text").cast("string").cast("binary").alias("text") if n == "text" else F.col(f"`{n}`") for n in names))
    packed = plain.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc"), F.col("doc_id").alias("id"))
    joined = packed.join(lost, F.col("id").eqNullSafe(F.col("lost_id")), "left").select("doc.*", F.col("l1").alias("_lost 1"), F.col("l2").alias("_lost 2"))

    def run(batches):
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, one, two in zip(b.column("text"), b.column("_lost 1"), b.column("_lost 2"), strict=True):
                text = text.as_py() or b""
                n = text.count(b"\n") + 1
                if one.as_py() is None:
                    kept.append(text)
                    n_dropped.append(0)
                else:
                    gone = np.column_stack([np.asarray(one.values), np.asarray(two.values)]).tobytes()
                    gone = {gone[i : i + 16] for i in range(0, len(gone), 16)}
                    parts, stay = [], 0
                    for part in _lines(text):
                        mine = [x for x in part if key_hash(x, least) not in gone]
                        stay += len(mine)
                        parts += [b"\n".join(mine)] if mine else []
                    n_dropped.append(n - stay)
                    kept.append(b"\n".join(parts))
                n_lines.append(n)
            columns = [pa.array(kept, pa.binary()).view(pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    out = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(run, out)
