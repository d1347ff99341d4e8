"""A paged source: tables that are handed out in pages, some hundred keys at a time, as a Python data source of Spark.

A page is a text, base64 of gzip of JSON: {"results": [rows], "next_offset": where the next page of its keys begins, or null}. Keys are dealt
into chunks of about a hundred, each read by a task of its own from offset to offset. Bounds of time and identifiers are pushed
down: they go to the chunks and pages that a manifest names, so that others aren't opened. Spark applies all filters again.

    register(spark)
    spark.read.format("paged").schema(schema).load(path).where(...)
"""

from __future__ import annotations

import base64
import gzip
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import KEY, TIME

KEYS_PER_CHUNK, ROWS_PER_PAGE = 100, 5_000
MANIFEST = "chunk long, page long, file string, first long, last long, n long"
_EPOCH = datetime(1970, 1, 1)


def pack(results: list[dict], next_offset: int | None) -> str:
    return base64.b64encode(gzip.compress(json.dumps({"results": results, "next_offset": next_offset}).encode())).decode()


def unpack(text: str) -> tuple[list[dict], int | None]:
    found = json.loads(gzip.decompress(base64.b64decode(text)))
    return found["results"], found["next_offset"]


def micros(t: datetime) -> int:
    if t.tzinfo:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return (t - _EPOCH) // timedelta(microseconds=1)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if found else path
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def chunk_of(key: str, chunks: int) -> int:
    """The chunk of a key: the same on both sides, whatever the engine's hash."""
    return zlib.crc32(key.encode()) % chunks


def write_pages(df: DataFrame, path: str, keys_per_chunk: int = KEYS_PER_CHUNK, rows_per_page: int = ROWS_PER_PAGE, key: str = KEY, time: str = TIME) -> None:
    """Lays a table down as pages, in the order of time within a chunk, and a manifest of them. Rows without a key or time are left out.

    A page is written by the task that has its rows; of a task that runs twice only the files count that the manifest names.
    """
    spark = df.sparkSession
    df = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    chunks = max(1, -(-df.select(key).distinct().count() // keys_per_chunk))
    plain = F.to_json(F.struct(*(F.unix_micros(F.col(f.name).cast("timestamp")).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name) for f in df.schema.fields)))
    rows = df.select((F.crc32(F.col(key).cast("string").cast("binary")) % chunks).alias("chunk"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), plain.alias("row"))
    order = Window.partitionBy("chunk").orderBy("at", "row")
    rows = rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / rows_per_page))
    rows = rows.withColumn("more", F.max("page").over(Window.partitionBy("chunk")) > F.col("page"))

    def put(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["at", "row"])
        page = int(p["page"].iloc[0])
        name = f"{uuid.uuid4().hex}.page"
        system, at = open_path(path)
        system.create_dir(f"{at}/pages", recursive=True)
        with system.open_output_stream(f"{at}/pages/{name}") as f:
            f.write(pack(list(map(json.loads, p["row"])), page + 1 if p["more"].iloc[0] else None).encode())
        return pd.DataFrame({"chunk": [int(p["chunk"].iloc[0])], "page": [page], "file": [name], "first": [int(p["at"].min())], "last": [int(p["at"].max())], "n": [len(p)]})

    rows.groupBy("chunk", "page").applyInPandas(put, MANIFEST).withColumn("chunks", F.lit(chunks)).write.parquet(f"{path}/manifest")


class Chunk(InputPartition):
    """The pages of some keys that may hold rows in the bounds, by offset, and the identifiers asked for."""

    def __init__(self, files: dict[int, str], ids: frozenset[str] | None = None):
        super().__init__(min(files))
        self.files, self.ids = files, ids


@dataclass
class Bounds:
    low: int | None = None
    high: int | None = None
    ids: frozenset[str] | None = None

    def meets(self, first: int, last: int) -> bool:
        return (self.low is None or last >= self.low) and (self.high is None or first <= self.high)


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, key: str, time: str):
        self.schema, self.path, self.key, self.time, self.bounds = schema, path, key, time, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (name of the interface)
        b = self.bounds
        for f in filters:
            if getattr(f, "attribute", None) == (self.time,) and isinstance(getattr(f, "value", None), datetime):
                at = micros(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    b.low = at if b.low is None else max(b.low, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    b.high = at if b.high is None else min(b.high, at)
            if getattr(f, "attribute", None) == (self.key,) and isinstance(f, (EqualTo, In)):
                ids = frozenset(f.value if isinstance(f, In) else [f.value])
                b.ids = ids if b.ids is None else b.ids & ids
            yield f  # pages are chosen, rows are Spark's to filter

    def partitions(self) -> list[Chunk]:
        """One for each chunk that has pages in the bounds. The manifest has a row a page."""
        import pyarrow.parquet as pq

        system, at = open_path(self.path)
        files = [x.path for x in system.get_file_info(fs.FileSelector(f"{at}/manifest")) if x.path.endswith(".parquet")]
        pages = pd.concat([pq.read_table(f, filesystem=system).to_pandas() for f in files]) if files else pd.DataFrame(columns=["chunk", "page", "file", "first", "last", "n", "chunks"])
        b, out = self.bounds, []
        for chunk, p in pages.groupby("chunk"):
            ids = None if b.ids is None else frozenset(k for k in b.ids if chunk_of(k, int(p["chunks"].iloc[0])) == chunk)
            found = {int(r.page): r.file for r in p.sort_values("page").itertuples() if b.meets(r.first, r.last)}
            if found and (ids is None or ids):
                out.append(Chunk(found, ids))
        return out

    def read(self, partition: Chunk) -> Iterator[tuple]:
        system, at = open_path(self.path)
        times = [isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) for f in self.schema.fields]
        aware = [isinstance(f.dataType, T.TimestampType) for f in self.schema.fields]
        offset = min(partition.files)
        while offset is not None:
            if offset not in partition.files:  # times rise with the offset: no later page is in the bounds
                return
            with system.open_input_stream(f"{at}/pages/{partition.files[offset]}") as f:
                results, offset = unpack(f.read().decode())
            for r in results:
                if partition.ids is not None and r[self.key] not in partition.ids:
                    continue
                row = []
                for f, is_time, is_aware in zip(self.schema.fields, times, aware, strict=True):
                    v = r.get(f.name)
                    if is_time and v is not None:
                        v = _EPOCH + timedelta(microseconds=v)
                        v = v.replace(tzinfo=timezone.utc) if is_aware else v
                    row.append(v)
                yield tuple(row)


class PagedSource(DataSource):
    """Options: path; key and time, the columns by which pages are chosen."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged table is read with a schema")

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options["path"], self.options.get("key", KEY), self.options.get("time", TIME))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it push filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
