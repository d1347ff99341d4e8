"""Files, entities and generated series."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import fill
from tidemark.sources import entities, files, synthetic


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_csv_sources(spark, tmp_path):
    who = spark.createDataFrame([("F1", "a"), ("F2", "b")], "figi string, unique_identifier string")
    p = write(tmp_path, "p.csv", "time_index,figi,price\n2024-01-01,F1,1.5\n2024-01-02,F9,9\n2024-01-03,F2,2\n")
    assert sorted((r.unique_identifier, r.open) for r in files.external_prices(spark, p, who).collect()) == [("a", 1.5), ("b", 2.0)]
    since = spark.createDataFrame([("a", datetime(2024, 1, 1))], "unique_identifier string, max_time timestamp")
    assert [r.unique_identifier for r in files.external_prices(spark, p, who, since).collect()] == ["b"]
    w = write(tmp_path, "w.csv", "figi,time_index,price,weight\nF1,2024-01-01,1,0.5\n")
    assert files.external_weights(spark, w, who).first().signal_weight == 0.5
    with pytest.raises(ValueError):
        files.external_portfolio(spark, p)
    f = write(tmp_path, "f.csv", "date,rate\n01/02/2024,5.5\n01/03/2024,5.6\n")
    assert [r.rate for r in files.fixings_csv(spark, f, date(2024, 1, 2)).collect()] == [0.055]
    with pytest.raises(ValueError):
        files.fixings_csv(spark, f, date(2024, 2, 1))
    c = write(tmp_path, "c.csv", "240101,5.0\n240131,5.1\n")
    assert [(r.days, round(r.zero, 4)) for r in files.curve_csv(spark, c, "x").collect()] == [(0, 0.05), (30, 0.051)]


def test_portfolio_rows(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d), float(d), {"a": 1.0}, 3) for d in (1, 2)], "time_index timestamp, close double, volume map<string,double>, other int")
    out = files.portfolio_rows(df, datetime(2024, 1, 2))
    assert out.columns == ["time_index", "close", "volume"] and out.first().volume == '{"a":1.0}' and out.count() == 1


def test_entities(spark):
    e = spark.createDataFrame([("a", 1, ("x",)), ("b", 2, ("y",)), ("c", None, ("y",))], "unique_identifier string, n int, s struct<k:string>")
    ids = lambda **f: sorted(r.unique_identifier for r in entities.filtered(e, **f).collect())
    assert ids(n__in=[1, 2]) == ["a", "b"] and ids(n__gte=2) == ["b"] and ids(s__k="y") == ["b", "c"] and ids(n=None) == ["c"] and ids(n__isnull=False, s__k="y") == ["b"]
    assert entities.get(e, n=1).unique_identifier == "a"
    for bad in ({"n": 9}, {"s__k": "y"}):
        with pytest.raises(LookupError):
            entities.get(e, **bad)
    s = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 2, 1)), ("a", date(2024, 2, 1), None)], "unique_identifier string, effective_from date, effective_to date")
    assert entities.current(s).count() == 1 and entities.as_of(s, date(2024, 1, 31)).first().effective_from == date(2024, 1, 1) and entities.as_of(s, date(2024, 2, 1)).first().effective_to is None
    m = spark.createDataFrame([("big", "a"), ("big", "a"), ("small", "b")], "category string, unique_identifier string")
    assert [r.unique_identifier for r in entities.in_category(e, m, "big").collect()] == ["a"]


def test_synthetic(spark):
    last = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "unique_identifier string, close double")
    one = synthetic.simulated_prices(spark, last, datetime(2024, 1, 1), datetime(2024, 3, 1))
    rows = sorted((r.unique_identifier, r.time_index, r.close) for r in one.collect())
    assert len(rows) == 120 and rows == sorted((r.unique_identifier, r.time_index, r.close) for r in one.repartition(3).collect()) and all(c > 0 for *_, c in rows)
    x = np.array([r.random_number for r in synthetic.random_daily(spark, datetime(2020, 1, 1), datetime(2024, 1, 1)).collect()])
    assert abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1


def test_weekly_last(spark):
    t = pd.date_range("2024-01-01", periods=20, freq="D")
    v = [None if i in (6, 13) else float(i) for i in range(20)]
    df = spark.createDataFrame([(d.to_pydatetime(), "a", x) for d, x in zip(t, v, strict=True)], "time_index timestamp, unique_identifier string, v double")
    out = [(r.time_index, r.v) for r in fill.weekly_last(df, ["v"]).orderBy("time_index").collect()]
    want = pd.Series(v, t, dtype=float).resample("W").last()
    assert out == [(i.to_pydatetime(), x) for i, x in want.items()]
