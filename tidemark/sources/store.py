"""A store of panel tables: Hive-partitioned Parquet, read by range, upserted by key.

table/v=<version>/_part=YYYYMM[DD]/*.parquet; the pointer file of the highest number names the current version. A write
makes a new version next to the old one and then adds the next pointer, so a reader never sees half a write and a failed
one leaves the table as it was; of two writers that began from the same pointer the second fails. Partitions that a write doesn't touch aren't rewritten: they are read from where they are, through the
version's list of parts. All file work goes through Hadoop's FileSystem, so any URI that Spark reads will do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge, ranges
from ..schema import KEY, TIME, reject_duplicates, validate_update

#: Pointer files that stay beside the current one, for readers that have just listed them.
KEPT_POINTERS = 3
#: Rows of a file that a compaction writes, about.
FILE_ROWS = 250_000


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...] = (TIME, KEY)
    partition: str = "month"
    schema: str = "{}"
    parts: tuple[tuple[str, str], ...] = ()  # (partition, path); a partition may have several paths, of different keys
    meta: str = "{}"  # what is known of the table and its columns, as JSON
    version: int = 0  # number of the pointer that it was read from; 0: not stored yet


class PanelStore:
    """Tables under one root folder.

    A table's descriptor lists the paths of its partitions; its size grows with the number of partitions, not rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # -- descriptors

    def _pointers(self, name: str) -> list[int]:
        """Numbers of the table's pointer files, ascending."""
        at = self._path(f"{self.root}/{name}")
        found = [re.fullmatch(r"current-(\d+)\.json", s.getPath().getName()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for m in found if m)

    def _pointer(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/current-{version:09d}.json"

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def names(self) -> list[str]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()) if self.exists(n))

    def describe(self, name: str) -> Table | None:
        held = self._pointers(name)
        if not held:
            return None
        text = self.spark.read.option("wholetext", True).text(self._pointer(name, held[-1])).first()[0]
        d = json.loads(text)
        return Table(d["name"], tuple(d["keys"]), d["partition"], d["schema"], tuple(map(tuple, d["parts"])), d.get("meta", "{}"), held[-1])

    def _publish(self, t: Table) -> Table:
        """Makes t, which was read from pointer t.version, the current version; raises if another writer was faster."""
        staged = self._path(f"{self.root}/{t.name}/_staged-{uuid.uuid4().hex}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({"name": t.name, "keys": t.keys, "partition": t.partition, "schema": t.schema, "parts": t.parts, "meta": t.meta}).encode()))
        out.close()
        try:  # a rename that doesn't overwrite
            self._context.rename(staged, self._path(self._pointer(t.name, t.version + 1)), self._no_option)
        except Exception as e:
            self._fs.delete(staged, False)
            raise RuntimeError(f"{t.name} was written by another writer meanwhile: upsert again") from e
        for old in self._pointers(t.name)[: -1 - KEPT_POINTERS]:
            self._fs.delete(self._path(self._pointer(t.name, old)), False)
        return replace(t, version=t.version + 1)

    def annotate(self, name: str, columns: Mapping[str, Mapping] | None = None, table: Mapping | None = None) -> Table:
        """Keeps metadata with the table: of columns by their names, which must exist, and of the table itself."""
        t = self.describe(name)
        known = {f["name"] for f in json.loads(t.schema)["fields"]}
        if lost := sorted(set(columns or {}) - known):
            raise ValueError(f"no such columns: {lost}")
        held = json.loads(t.meta)
        meta = {"columns": held.get("columns", {}) | {k: dict(v) for k, v in (columns or {}).items()}, "table": held.get("table", {}) | dict(table or {})}
        return t if meta == held else self._publish(replace(t, meta=json.dumps(meta, sort_keys=True)))

    # -- reads

    def scan(self, name: str, partitions: Iterable[str] | None = None) -> DataFrame | None:
        """All rows with the registered types; files without a column give null. None if there is no table."""
        t = self.describe(name)
        if t is None:
            return None
        schema = T.StructType.fromJson(json.loads(t.schema))
        wanted = None if partitions is None else set(partitions)
        paths = [p for part, p in t.parts if wanted is None or part in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, start=None, end=None, **options) -> DataFrame | None:
        """Range read; see operators.ranges.range_read. Partitions outside [start, end] aren't listed at all."""
        t = self.describe(name)
        if t is None:
            return None
        inside = None
        if options.get("ranges") is None and (start is not None or end is not None):
            lo = _utc_day(start) if start is not None else "0"
            hi = _utc_day(end) if end is not None else "9"
            inside = [p for p, _ in t.parts if _bounds(p)[1] >= lo and _bounds(p)[0] <= hi]
        df = self.scan(name, inside)
        return ranges.range_read(df, start, end, key=t.keys[1] if len(t.keys) > 1 else KEY, time=t.keys[0], **options)

    def view(self, name: str, view: str | None = None) -> None:
        """A typed view; partition folders are no columns of it."""
        self.scan(name).createOrReplaceTempView(view or name)

    def minima(self, name: str) -> DataFrame:
        return ranges.time_minima(self.scan(name))

    def capped(self, name: str, max_rows: int = 10_000_000, start=None, **options) -> DataFrame:
        """The earliest partitions whose rows, by file footers, come to max_rows at most, one partition at least.

        Counting reads footers only. The cap tightens the end of every bound and never changes the arguments.
        """
        t = self.describe(name)
        total, kept = 0, []
        lo = _utc_day(start) if start is not None else "0"
        for part in sorted({p for p, _ in t.parts}):
            if _bounds(part)[1] < lo:
                continue
            total += self.scan(name, [part]).count()
            if kept and total > max_rows:
                break
            kept.append(part)
        return ranges.range_read(self.scan(name, kept), start, **options)

    # -- writes

    def upsert(self, df: DataFrame, name: str, keys: Sequence[str] = (TIME, KEY), partition: str = "month", mode: str = "coalesce", order: Sequence[str] | None = None) -> Table:
        """Writes rows by key; see operators.merge.upsert. Repeated keys in the batch: the last by ``order``, or an error.

        Only partitions that the batch has rows for are read. If no key of the batch is stored yet, it is added to them as
        further files; else they are rewritten. A column's registered type stays: the batch is cast to it, and a cast that
        loses a value raises.
        """
        t = self.describe(name) or Table(name, tuple(keys), partition)
        df = validate_update(df, t.keys)
        known = {f["name"]: f for f in json.loads(t.schema).get("fields", [])}
        for c in df.columns:
            if c in known:
                df = df.withColumn(c, F.col(c).cast(T.StructField.fromJson(known[c]).dataType))
        if order:
            df = merge.keep_one(df, order, t.keys)
        # the batch is looked at several times, so it is computed once; of new keys alone, it is the new files
        base, schema = self._base(t), df.schema
        self._lay(t, df.withColumn("_part", _part(t, df)).hint("rebalance", F.col("_part")), base)
        added = False
        try:
            made = self._parts(base)
            df = self.spark.read.schema(schema).parquet(base).select(*df.columns)
            if not order:
                reject_duplicates(df, t.keys)
            touched = [p for p, _ in made]
            old = self.scan(name, touched) if known else None
            # no broadcast: packed files of keys look much smaller than their rows are
            if old is None or not merge.overlap_exists(old.hint("merge"), df, t.keys):
                wider = df if old is None else old.limit(0).unionByName(df, allowMissingColumns=True)
                done = self._commit(t, wider.schema, [*t.parts, *made])
                added = True
                return done
            return self._write(t, merge.upsert(old, df, t.keys, mode), touched)
        finally:
            if not added:
                self._fs.delete(self._path(base), True)

    def _base(self, t: Table) -> str:
        return f"{self.root}/{t.name}/v={uuid.uuid4().hex}"

    def _lay(self, t: Table, df: DataFrame, base: str) -> None:
        """Writes rows with their _part; in each file they lie sorted."""
        df.sortWithinPartitions("_part", *t.keys[1:], t.keys[0]).write.partitionBy("_part").option("compression", "zstd").parquet(base)

    def _parts(self, base: str) -> list[tuple[str, str]]:
        """(partition, path) of what was written there."""
        found = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(base)) if s.isDirectory()) if n.startswith("_part="))
        if bad := [n for n in found if not n.removeprefix("_part=").isdigit()]:
            raise ValueError(f"rows without a time: {bad}")
        return [(n.removeprefix("_part="), f"{base}/{n}") for n in found]

    def _commit(self, t: Table, schema: T.StructType, parts: Iterable[tuple[str, str]]) -> Table:
        kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).json()
        return self._publish(Table(t.name, t.keys, t.partition, kinds, tuple(sorted(parts)), t.meta, t.version))

    def _write(self, t: Table, df: DataFrame, touched: Sequence[str], keep: bool = False) -> Table:
        """Writes partitions next to the old ones; with keep, in addition to them, else in their place."""
        base = self._base(t)
        # Spark makes a few files of a partition, more of a large one
        self._lay(t, df.withColumn("_part", _part(t, df)).hint("rebalance", F.col("_part")), base)
        return self._commit(t, df.schema, [*((p, path) for p, path in t.parts if keep or p not in touched), *self._parts(base)])

    def drop_columns(self, name: str, columns: Sequence[str]) -> dict:
        """Rewrites the table without the columns; keys stay. Says what was dropped and what was skipped."""
        t = self.describe(name)
        df = self.scan(name)
        gone = [c for c in columns if c in df.columns and c not in t.keys]
        parts = sorted({p for p, _ in t.parts})
        if gone:
            self._rewrite(t, gone)
        return {"dropped": gone, "skipped": [c for c in columns if c not in gone], "partitions_rebuilt": len(parts) if gone else 0}

    def compact(self, name: str) -> Table:
        """Rewrites all partitions, one row a key, that of the newest file; small files are merged."""
        return self._rewrite(self.describe(name))

    def _rewrite(self, t: Table, gone: Sequence[str] = ()) -> Table:
        """Writes all partitions anew without the columns, one row a key: of the file written last, then that of the largest values.

        Rows are dealt once, by partition and a hash of their other keys, so that no file has more than about FILE_ROWS rows; in the
        order in which the last row of a key is found, they are also written.
        """
        df = self.scan(t.name)
        kept = df.drop(*gone)
        if not t.parts:
            return self._commit(t, kept.schema, [])
        rest = [F.col(c) for c in df.columns if c not in t.keys]
        aged = df.select("*", F.col("_metadata.file_modification_time").alias("_written"), _part(t, df).alias("_part"))
        most = aged.groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
        files = -(-(most[0] or 1) // FILE_ROWS)
        spread = F.pmod(F.hash(*t.keys[1:]), F.lit(files)) if len(t.keys) > 1 else F.lit(0)
        aged = aged.withColumn("_file", spread).repartition(max(1, most[1]) * files, "_part", "_file")
        newest = merge.keep_one(aged, ["_written", F.struct(*rest)] if rest else ["_written"], ("_part", "_file", *t.keys[1:], t.keys[0]))
        base = self._base(t)
        self._lay(t, newest.select(*kept.columns, "_part"), base)
        return self._commit(t, kept.schema, self._parts(base))

    def drop(self, name: str, files: bool = False) -> None:
        """Forgets a table; its files go only if asked for."""
        if files:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        else:
            for version in self._pointers(name):
                self._fs.delete(self._path(self._pointer(name, version)), False)

    def vacuum(self, name: str) -> int:
        """Deletes versions that no partition refers to; readers of older versions must be done."""
        t = self.describe(name)
        used = {p.rsplit("/", 1)[0] for _, p in t.parts}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.isDirectory() and s.getPath().getName().startswith("v=") and not any(u.endswith(s.getPath().getName()) for u in used)]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def reconcile(self, remote: DataFrame) -> dict[str, list[str]]:
        """Names on one side only. remote has a column name."""
        local = self.spark.createDataFrame([(n,) for n in self.names()], "name string")
        both = {"only_local": merge.names_only_left(local, remote), "only_remote": merge.names_only_left(remote.select("name"), local)}
        return {k: sorted(r.name for r in v.collect()) for k, v in both.items()}


def _utc_day(at: datetime) -> str:
    """The day in UTC, in which partitions are; a time without a zone is UTC."""
    return (at.astimezone(timezone.utc) if at.tzinfo else at).strftime("%Y%m%d")


def _part(t: Table, df: DataFrame):
    """Month or day in UTC, whatever the session's zone; a time without a zone is UTC."""
    form, at = "yyyyMM" if t.partition == "month" else "yyyyMMdd", F.col(t.keys[0])
    if isinstance(df.schema[t.keys[0]].dataType, T.TimestampType):
        at = F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))
    return F.date_format(at, form)


def _bounds(part: str) -> tuple[str, str]:
    return (f"{part}01", f"{part}31") if len(part) == 6 else (part, part)


def _quoted(value) -> str:
    """A literal of standard SQL."""
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _name(column: str) -> str:
    """A column as standard SQL names it, which keeps its case."""
    return '"' + column.replace('"', '""') + '"'


def database_predicates(bounds: Sequence[tuple] = (), ids: Sequence | None = None, ranges: Mapping[str, ranges.Range] | None = None, key: str = KEY, time: str = TIME, group: int = 100) -> list[str]:
    """WHERE conditions that reach the database, one query and so one partition each.

    Time bands [a, b); ids in groups of ``group``; or ranges by id (start, end and their operands), ids of equal ranges together.
    """
    key, time = _name(key), _name(time)
    bands = [" AND ".join(f"{time} {op} {_quoted(x)}" for op, x in ((">=", a), ("<", b)) if x is not None) or "1 = 1" for a, b in bounds] or ["1 = 1"]
    grouped = lambda names: [list(names)[i : i + group] for i in range(0, len(names), group)]
    among = lambda names: f"{key} IN ({', '.join(map(_quoted, names))})"
    if ranges is not None:
        alike: dict[str, list] = {}
        for name, r in ranges.items():
            sides = [f"{time} {r.start_operand} {_quoted(r.start)}"] * (r.start is not None) + [f"{time} {r.end_operand} {_quoted(r.end)}"] * (r.end is not None)
            alike.setdefault(" AND ".join(sides) or "1 = 1", []).append(name)
        of_ids = [f"{among(g)} AND {c}" for c, names in alike.items() for g in grouped(names)]
    else:
        of_ids = ["1 = 1"] if ids is None else [among(g) for g in grouped(ids)]
    return [" AND ".join(x for x in (a, b) if x != "1 = 1") or "1 = 1" for a in bands for b in of_ids]


def read_database(spark: SparkSession, url: str, table: str, columns: Sequence[str], bounds: Sequence[tuple] = (), ids: Sequence | None = None, ranges: Mapping[str, ranges.Range] | None = None, properties: Mapping[str, str] | None = None, key: str = KEY, time: str = TIME) -> DataFrame:
    """A range read over JDBC; filters and columns reach the database. See database_predicates. No ids: no rows."""
    predicates = database_predicates(bounds, ids, ranges, key, time)
    return spark.read.jdbc(url, table, predicates=predicates or ["1 = 0"], properties=dict(properties or {})).select(*columns)


def write_database(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, rows: int = 10_000, tasks: int = 4) -> None:
    """Appends in batches from a bounded number of connections."""
    df.coalesce(tasks).write.option("batchsize", rows).jdbc(url, table, mode="append", properties=dict(properties or {}))


def replacement_sql(table: str, staging: str, columns: Sequence[str], key: str | None = KEY, time: str = TIME) -> list[str]:
    """Statements of one transaction: delete what lies in the staged rows' span (of their ids, if keyed), insert them, drop the stage."""
    t, names = _name(time), ", ".join(map(_name, columns))
    if key is None:
        gone = f"DELETE FROM {table} WHERE {t} >= (SELECT min({t}) FROM {staging}) AND {t} <= (SELECT max({t}) FROM {staging})"
    else:
        k = _name(key)
        span = f"SELECT min({t}) AS lo, max({t}) AS hi, {k} AS k FROM {staging} GROUP BY {k}"
        gone = f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM ({span}) s WHERE s.k = {table}.{k} AND {table}.{t} >= s.lo AND {table}.{t} <= s.hi)"
    return [gone, f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}", f"DROP TABLE {staging}"]


def execute(spark: SparkSession, url: str, statements: Sequence[str], properties: Mapping[str, str] | None = None) -> None:
    """Runs statements in one transaction; an error rolls all of them back."""
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.execute(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def replace_in_database(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, key: str | None = KEY, time: str = TIME) -> None:
    """Delete-then-insert: Spark's tasks write the rows to a stage with the table's types; then they take the place of the table's rows in their span, in one transaction."""
    spark, staging = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    if df.isEmpty():
        return
    names = ", ".join(map(_name, df.columns))
    execute(spark, url, [f"CREATE TABLE {staging} AS SELECT {names} FROM {table} WITH NO DATA"], properties)
    try:
        write_database(df, url, staging, properties)
        execute(spark, url, replacement_sql(table, staging, df.columns, key, time), properties)
    except Exception:
        execute(spark, url, [f"DROP TABLE {staging}"], properties)
        raise


def read_artifact(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV artifact with a header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
