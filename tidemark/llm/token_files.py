"""Token counts: a separator scan over flat token files without an index.

A token file is nothing but token ids of two bytes, low byte first, documents one after the other, each closed by ``eod``.
A task writes its tokens to a file of its own and hands on which document is at which place of it, so that names and
tokens come from the same run of the same task. The scan knows the files only: Spark deals their byte ranges over tasks,
each searches its range for separators at once, and documents that cross ranges are stitched by prefix sums over the
ranges' heads and tails.

Files are opened by Arrow's file systems (local paths, s3://, gs://, hdfs://), so the folder must be one that these reach.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No id of a vocabulary of fewer than 65,535 tokens.
EOD = 0xFFFF
#: Bytes of a range.
BLOCK = 8 << 20


def vocabulary_of(folder: str, vocabulary: str) -> tuple[str, bytes]:
    """The pattern that cuts texts, and the vocabulary file; read on the driver and broadcast, some megabytes."""
    spec = importlib.util.spec_from_file_location("vocabulary_folder", os.path.join(folder, "__init__.py"))
    about = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(about)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return about.PATTERN, f.read()


def encoder(pattern: str, content: bytes):
    """The byte-pair encoder over a public vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it."""
    scheme, found, rest = path.partition(":")
    if not found:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def write_token_files(documents: DataFrame, path: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """One flat file for each task that has rows; returns (doc_id, file, ordinal): which document is where. Null texts have no tokens.

    The rows come back as a table that is already written. A task that is run again writes another file; only the files
    that the table names count.
    """
    spark = documents.sparkSession
    shown = spark.sparkContext.broadcast(vocabulary_of(folder, vocabulary))
    kind = documents.schema["doc_id"].dataType.simpleString()
    open_path(path)[0].create_dir(open_path(path)[1], recursive=True)

    def run(batches):
        enc = encoder(*shown.value)
        if enc.n_vocab > eod:
            raise ValueError("eod is an id of the vocabulary")
        name, n, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
        system, at = open_path(path)
        try:
            for b in batches:
                out = out or system.open_output_stream(f"{at}/{name}")
                for t in b.column("text"):
                    out.write(np.array([*enc.encode_ordinary(t.as_py() or ""), eod], dtype="<u2").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([name] * b.num_rows, pa.string()), pa.array(range(n, n + b.num_rows), pa.int64())], names=["doc_id", "file", "ordinal"])
                n += b.num_rows
        finally:
            if out is not None:
                out.close()

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, file string, ordinal long"), "document-places")


def scan_range(ids: np.ndarray, eod: int) -> tuple[int, np.ndarray, int]:
    """Tokens before the first separator, lengths between separators, tokens after the last; without one all is tail and head is -1."""
    at = np.flatnonzero(ids == eod)
    if len(at) == 0:
        return -1, np.zeros(0, np.int64), len(ids)
    return int(at[0]), np.diff(at) - 1, len(ids) - 1 - int(at[-1])


def scan_token_files(spark: SparkSession, path: str, files: Iterable[str] | DataFrame | None = None, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) for each document of the files in path, ordinals from 0. files: names, one a row (column file); None: all.

    A file of any size is cut in ranges of ``block`` bytes, each read and searched by itself. Tokens that a file holds
    after its last separator are a document that was never closed and are left out. An empty file holds no document.
    """
    step = block // 2 * 2

    def ranges(batches):
        system, at = open_path(path)
        for b in batches:
            for name in b.column("file").to_pylist():
                size = system.get_file_info(f"{at}/{name}").size // 2 * 2
                begin = np.arange(0, size, step, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(begin), pa.string()), pa.array(begin), pa.array(np.minimum(step, size - begin))], names=["file", "begin", "n"])

    def scan(batches):
        system, at = open_path(path)
        for b in batches:
            for name, begin, n in zip(*(b.column(c).to_pylist() for c in ("file", "begin", "n")), strict=True):
                with system.open_input_file(f"{at}/{name}") as f:
                    head, inner, tail = scan_range(np.frombuffer(f.read_at(n, begin), dtype="<u2"), eod)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([begin]), pa.array([head]), pa.array([inner], pa.list_(pa.int64())), pa.array([tail])], names=["file", "begin", "head", "inner", "tail"])

    if files is None:
        system, at = open_path(path)
        files = [x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and not x.base_name.startswith((".", "_"))]
    named = files if isinstance(files, DataFrame) else spark.createDataFrame([(x,) for x in files], "file string")
    held = named.select("file").mapInArrow(ranges, "file string, begin long, n long")
    blocks = held.repartition(F.col("file"), F.col("begin")).mapInArrow(scan, "file string, begin long, head long, inner array<long>, tail long")
    # documents closed before the range, and tokens that earlier ranges left open: prefix sums over a file's ranges
    order = Window.partitionBy("file").orderBy("begin")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.when(F.col("head") >= 0, F.size("inner") + 1).otherwise(0).cast("long")
    stitched = blocks.withColumns({"before": F.coalesce(F.sum(closed).over(earlier), F.lit(0)), "sum_tail": F.sum("tail").over(order)})
    # all tails since the last range with a separator, that one's included
    restart = F.last(F.when(F.col("head") >= 0, F.col("sum_tail") - F.col("tail")), ignorenulls=True).over(earlier)
    stitched = stitched.withColumn("open", F.col("sum_tail") - F.col("tail") - F.coalesce(restart, F.lit(0)))
    lengths = F.when(F.col("head") >= 0, F.concat(F.array(F.col("head") + F.col("open")), F.col("inner")))
    return stitched.select("file", "before", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """doc_id, n_tokens for every row of documents: writes the token files to the shared folder, then counts by scan.

    Null and empty texts have 0 tokens; repeated rows and null ids are counted each; other columns are ignored; an empty
    table gives none. documents may be any DataFrame: it is computed once. A document that the scan doesn't find raises.
    """
    spark = documents.sparkSession
    path = new_path(spark, "token-files")
    places = write_token_files(documents, path, folder, vocabulary, eod)
    found = materialize(scan_token_files(spark, path, places.select("file").distinct(), eod), "token-counts")
    out = places.join(found.withColumnsRenamed({"file": "f", "ordinal": "o"}), (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o")), "left")
    lost = F.when(F.col("n_tokens").isNull(), F.raise_error(F.lit("a document isn't in the token files"))).otherwise(F.col("n_tokens"))
    return out.select("doc_id", lost.cast("long").alias("n_tokens"))
