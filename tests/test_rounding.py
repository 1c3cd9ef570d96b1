"""Rounding to reported figures as the SQL has it: halves of doubles, %.1f, quantiles between neighbours; equal positions."""

import duckdb
import numpy as np
import pandas as pd

from pulsegrid.functions.columns import r6, tenths
from pulsegrid.operators import catalog, reports, screens


def test_halves_of_a_millionth(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(-100, 100, 3000), 6) + 5e-7
    df = pd.DataFrame({"x": np.append(x, [0.0078125, -0.0078125, 8.2569445, 1e9 + 0.5])})
    want = [v for (v,) in duckdb.connect().register("d", df).sql("SELECT round(x, 6) FROM d").fetchall()]
    assert [r.v for r in spark.createDataFrame(df).coalesce(1).select(r6("x").alias("v")).collect()] == want


def test_one_decimal_as_in_c(spark):
    x = [72.25, 72.35, 72.45, 72.75, 0.05, 0.15, 0.25, 0.35, 99.95, 99.949999, 3.0, 0.0, -1.25, 123.649999] + [round(k / 20, 2) for k in range(2001)]
    df = spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)
    assert [f"{r.v:.1f}" for r in df.select(tenths("x").alias("v")).collect()] == [f"{v:.1f}" for v in x]
    rows = spark.createDataFrame([(1, 9, 72.25, 20.35, "low")], "record long, n long, mean_hr_bpm double, rmssd_ms double, risk string")
    assert reports.sentences(rows).first().report == "Record 1: 9 intervals, mean rate 72.2 bpm, RMSSD 20.4 ms, low risk."


def test_quantiles_equal_sql(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame([(r, float(v)) for r in range(150) for v in np.round(rng.uniform(50, 100, 1 + r % 80), 5)], columns=["record", "x"])
    shares = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    want = duckdb.connect().register("d", df).sql(f"SELECT record, {', '.join(f'quantile_cont(x, {p})' for p in shares)} FROM d GROUP BY record ORDER BY record").fetchall()
    got = screens.quantiles(spark.createDataFrame(df), "x", shares).orderBy("record").collect()
    assert [(r.record, *r.q) for r in got] == want


def test_equal_positions_are_in_one_cluster(spark):
    rows = [(1, float(v)) for v in (10, 20, 31) for _ in range(50)]
    got = catalog.gap_clusters(spark.createDataFrame(rows, "record long, x double"), 2.0).orderBy("cluster").collect()
    assert [tuple(r) for r in got] == [(1, 1, 50, 10.0, 0.0), (1, 2, 50, 20.0, 0.0), (1, 3, 50, 31.0, 0.0)]
