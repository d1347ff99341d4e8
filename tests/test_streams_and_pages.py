"""Streams with state, paged sources and participation: restarts, disorder, pages that aren't opened, random targets."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tidemark import more_queries
from tidemark.operators import bars, portfolio
from tidemark.schema import KEY, TIME
from tidemark.sources import paged
from tidemark.streaming import state

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
HOUR = 3_600_000_000


def test_a_restarted_stream_gives_what_the_batch_gives(spark):
    a = more_queries.streamed_gap_fill(spark, DATA)
    b = more_queries.intraday_gap_fill(spark, DATA).select(a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.where("interpolated").count() > 0


def test_bars_out_of_order_and_repeated(spark, tmp_path):
    """Within the watermark order doesn't matter; of repeated bars one counts; keys that are null and bars outside sessions are left out."""
    rng = random.Random(4)
    kind = f"{TIME} timestamp_ntz, {KEY} string, open double, high double, low double, close double, volume double, trade_count long, vwap double"
    rows = []
    for k in "ab":
        for h in range(60):
            if rng.random() < 0.6:
                v = float(rng.randrange(1, 9))
                rows.append((T0 + timedelta(hours=h), k, v, v, v, None if rng.random() < 0.2 else v, v, 1, None if rng.random() < 0.3 else v))
    rows += rows[:5] + [(T0 + timedelta(hours=9), None, *[1.0] * 5, 1, 1.0), (T0 + timedelta(hours=23), "a", *[1.0] * 5, 1, 1.0)]
    df = spark.createDataFrame(rows, kind)
    days = spark.createDataFrame([((T0 + timedelta(days=d)).date(), T0 + timedelta(days=d, hours=8), T0 + timedelta(days=d, hours=20)) for d in range(3)], "session date, market_open timestamp_ntz, market_close timestamp_ntz")
    late = sorted(rows, key=lambda r: (r[0] + timedelta(hours=rng.randrange(6))))
    for i in range(3):
        part = late[i * len(late) // 3 : (i + 1) * len(late) // 3]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.closing(df, T0 + timedelta(days=30)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        out = state.fill_stream(stream, days, "1h", "12 hours")
        out.writeStream.format("memory").queryName("filled").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("filled")
    want = bars.fill_intraday(df.where(F.col(KEY).isNotNull()), days, "1h").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_session_without_a_whole_bar_has_no_grid():
    s, whole = state.Session(HOUR), {"open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0}
    assert list(s.take(2 * HOUR, {"close": 5.0}, (0, 4 * HOUR))) == []
    out = list(s.take(12 * HOUR, whole, (10 * HOUR, 14 * HOUR)))
    assert [(r[0] // HOUR, r[4], r[-1]) for r in out] == [(10, 5.0, True), (11, 5.0, True), (12, 1.0, False)]
    out = list(s.take(20 * HOUR, whole, (20 * HOUR, 24 * HOUR)))
    assert [r[0] // HOUR for r in out] == [13, 14, 20]


def pages(spark, tmp_path):
    rows = [(T0 + timedelta(hours=h), f"id{k}", float(k * h), None if h % 2 else "é") for k in range(25) for h in range(40)]
    df = spark.createDataFrame([*rows, (None, "id1", 1.0, "x"), (T0, None, 1.0, "x")], f"{TIME} timestamp, {KEY} string, value double, note string")
    paged.write_pages(df, f"file://{tmp_path}/p", keys_per_chunk=5, rows_per_page=30)
    paged.register(spark)
    return df.dropna(subset=[TIME, KEY]), spark.read.format("paged").schema(df.schema).load(f"file://{tmp_path}/p")


def test_pages_hold_all_rows(spark, tmp_path):
    df, found = pages(spark, tmp_path)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
    where = (F.col(TIME) > T0 + timedelta(hours=7)) & (F.col(TIME) <= T0 + timedelta(hours=19)) & F.col(KEY).isin("id3", "id17", "nobody")
    assert sorted(map(str, found.where(where).collect())) == sorted(map(str, df.where(where).collect()))
    assert found.where(F.col(KEY) == "nobody").collect() == []


def test_pages_outside_the_bounds_are_not_opened(spark, tmp_path):
    df, _ = pages(spark, tmp_path)
    reader = lambda: paged.PagedReader(df.schema, f"file://{tmp_path}/p", KEY, TIME)
    every = sum(len(c.files) for c in reader().partitions())
    r = reader()
    filters = [GreaterThanOrEqual((TIME,), T0 + timedelta(hours=10)), LessThan((TIME,), T0 + timedelta(hours=12)), In((KEY,), ("id3", "id4"))]
    assert list(r.pushFilters(filters)) == filters
    some = r.partitions()
    assert 0 < sum(len(c.files) for c in some) <= every / 4 and {k for c in some for k in c.ids} == {"id3", "id4"}
    opened = [row for c in some for row in r.read(c)]
    assert {x[1] for x in opened} == {"id3", "id4"} and all(T0 + timedelta(hours=10) in {y[0].replace(tzinfo=None) for y in opened} for _ in [0])
    r = reader()
    list(r.pushFilters([EqualTo((KEY,), "id3"), EqualTo((KEY,), "id4")]))
    assert r.partitions() == []


@pytest.mark.parametrize("batch", [3, 10_000])
def test_participation_of_random_targets(spark, batch):
    rng = np.random.default_rng(3)
    rows = []
    for p in ("p", "q"):
        for k in "abc":
            target = 0.0
            for i in range(60):
                target = float(rng.normal()) if rng.random() < 0.3 else target
                rows.append((T0 + timedelta(hours=i), k, p, None if rng.random() < 0.05 else target, 10.0, None if rng.random() < 0.1 else float(rng.random())))
    df = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, {KEY} string, portfolio string, weights double, price double, volume double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = portfolio.volume_participation(df, 20.0, 0.5)
        assert dict(out.dtypes)[TIME] == "timestamp_ntz"
        found = {(r.portfolio, r[KEY], r[TIME]): r.weights for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for t, k, p, w, price, volume in rows:
        room, at = 0.5 * price * (volume or 0.0) / 20.0, held.get((p, k), 0.0)
        held[p, k] = at + min(max((w or 0.0) - at, -room), room)
        assert found[p, k, t] == pytest.approx(held[p, k], abs=1e-12)
