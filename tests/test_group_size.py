"""Kernels that carry state: groups bounded by what the state spans, with the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from pulsegrid.operators import events, images, oximetry


@pytest.fixture
def largest(monkeypatch, tmp_path):
    """The largest group that was handed to pandas."""
    plain = PandasGroupedOpsMixin.applyInPandas

    def noted(self, f, schema):
        def g(pdf: pd.DataFrame) -> pd.DataFrame:
            (tmp_path / f"{len(pdf)}").touch()
            return f(pdf)

        return plain(self, g, schema)

    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", noted)
    return lambda: max(int(x.name) for x in tmp_path.iterdir())


def test_trace_groups_are_places(spark, largest):
    rows = spark.range(6000).select(F.lit(1).alias("image"), (F.col("id") % 5).alias("x"), (F.col("id") * F.col("id") % 7).alias("y"))
    got = [(r.x, r.y) for r in images.following_trace(rows, 0.3, 0.5).orderBy("x").collect()]
    assert largest() <= 35 and [x for x, _ in got] == [0, 1, 2, 3, 4]
    pdf = rows.toPandas()
    assert got[0][1] in set(pdf.y[pdf.x == 0]) and abs(got[0][1] - pdf.y[pdf.x == 0].median()) <= 1


def greedy(d, t, tolerance):
    t, tp = sorted(t), 0
    for x in sorted(d):
        near = [y for y in t if abs(y - x) <= tolerance]
        if near:
            t.remove(min(near, key=lambda y: abs(y - x)))
            tp += 1
    return tp


def test_matching_by_pieces(spark, largest):
    rng = np.random.default_rng(1)
    d, t = ([float(x) for x in rng.integers(0, 3000, 400) / 4] for _ in range(2))
    frame = lambda v: spark.createDataFrame([(1, x) for x in v] + [(2, 1.0)] * (v is d), "record long, t double")
    got = {r.record: (r.tp, r.fp, r.fn) for r in events.match_events(frame(d), frame(t), 0.25).collect()}
    tp = greedy(d, t, 0.25)
    assert got == {1: (tp, 400 - tp, 400 - tp), 2: (0, 1, 0)} and largest() < 200


def scan(x, base, drop, gap):
    out, start, last = [], -1, -1
    for i in range(len(x)):
        if x[i] < base[i] - drop:
            start, last = (i, i) if start < 0 else (start, i)
        elif start >= 0 and (x[i] >= base[start] - 1 or i - last > gap):
            out.append((start, last + 1))
            start = -1
    return out + [(start, last + 1)] * (start >= 0)


def test_desaturations_stream_through(spark):
    rng = np.random.default_rng(2)
    x = np.round(96 + rng.normal(0, 2.5, 25_000), 1)
    rows = spark.createDataFrame([(1, 3 * i + 5, float(v)) for i, v in enumerate(x)] + [(2, 1, 99.0), (2, 2, 80.0)], "record long, idx long, spo2 double").repartition(5)
    base = [r.baseline for r in oximetry.rolling_baseline(rows, 20).where("record = 1").orderBy("idx").collect()]
    events = oximetry.desaturations(rows, 3.0, 20, 1).orderBy("record", "start").collect()
    got = [r for r in events if r.record == 1]
    assert [(r.start, r.end) for r in got] == scan(x, base, 3.0, 3) and len(got) > 20
    for r in got:
        part = x[r.start : r.end]
        assert (r.nadir, r.depth) == (part.min(), round(base[r.start] - part.min(), 6))
        assert abs(r.area - np.trapezoid(np.maximum(0, base[r.start] - part))) < 2e-6
    assert [tuple(r)[1:4] for r in events if r.record == 2] == [(1, 2, 1.0)]


def test_a_scan_keeps_little():
    scan_ = oximetry.DropScan(3.0, 1, 3, 1.0)
    for i in range(5000):
        assert scan_.feed(i, 80.0, 99.0) is None
        assert len(scan_.waiting) <= 3
    assert scan_.close()[:3] == (0, 5000, 5000.0)
