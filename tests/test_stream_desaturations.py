"""The stream of desaturations against the batch scan: several files, readings out of order, late ones, short records."""

import datetime
import json
import random

import numpy as np
import pandas as pd

from pulsegrid.operators import oximetry
from pulsegrid.streaming import desaturations as op

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, value double"


def readings(n, seed):
    """(record, second, spo2): record 3 is shorter than the baseline's window."""
    rng = np.random.default_rng(seed)
    return [(r, t, round(float(min(100, 95.5 + rng.normal(0, 3))), 1)) for r, m in ((1, n), (2, n), (3, 15)) for t in range(m)]


def write(spark, path, rows):
    data = [(k, START + datetime.timedelta(seconds=t), r, (100 - x) * 8) for k, (r, t, x) in enumerate(rows)]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(path)


def batch(spark, rows, width):
    df = spark.createDataFrame([(r, t, x) for r, t, x in rows], "record long, idx long, spo2 double")
    return sorted(map(tuple, oximetry.desaturations(df, 3.0, width, 1).collect()))


def test_files_one_by_one_equal_the_batch(spark, tmp_path):
    rows = readings(200, 1)
    path = str(tmp_path / "in")
    for part in range(4):  # within a file and across two of them, readings are out of order by less than the delay
        own = [x for x in rows if part * 50 - (x[1] % 3) * 4 <= x[1] < part * 50 + 50 - ((x[1] + 0) % 3) * 4 or (part == 3 and x[1] >= 190)]
        taken = {x[:2] for x in own}
        rows = [x for x in rows if x[:2] not in taken]
        random.Random(part).shuffle(own)
        write(spark, path, own)
    assert not rows
    whole = readings(200, 1)
    got = op.run_to_the_end(spark, path, lambda r: op.stream_desaturations(r, 3.0, 20, 1, delay="30 seconds", idle_ms=3_600_000), files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == batch(spark, whole, 20)


def test_late_readings_are_dropped(spark, tmp_path):
    rows, path = [x for x in readings(120, 2) if x[0] == 1], str(tmp_path / "in")
    late = [(1, 5.5, 40.0), (1, 7.5, 40.0)]
    write(spark, path, rows[:60])
    write(spark, path, rows[60:110])
    write(spark, path, late + rows[110:])
    got = op.run_to_the_end(spark, path, lambda r: op.stream_desaturations(r, 3.0, 20, 1, delay="10 seconds", idle_ms=3_600_000), files_per_batch=1)
    assert sorted(map(tuple, got.collect())) == batch(spark, rows, 20)


def test_a_pause_ends_a_record(spark, tmp_path):
    first, path = [(1, t, 80.0 if t in (30, 31) else 97.0) for t in range(40)], str(tmp_path / "in")
    write(spark, path, first + [(1, t + 10_000, 97.0 if t != 5 else 70.0) for t in range(12)])
    got = op.run_to_the_end(spark, path, lambda r: op.stream_desaturations(r, 3.0, 20, 1, delay="10 seconds", idle_ms=600_000))
    assert sorted((r.start, r.end) for r in got.collect()) == [(5, 6), (30, 32)]


def test_tracks_resume_and_stay_small():
    rng = random.Random(3)
    whole, cut = op.Track(3.0, 20, 1, 3, 1.0), op.Track(3.0, 20, 1, 3, 1.0)
    a, b = [], []
    for _ in range(3000):
        x = round(min(100, rng.gauss(95, 4)), 1)
        a += whole.feed(x)
        b += cut.feed(x)
        text = cut.dump()
        assert len(text) < 1500 and len(json.loads(text)["recent"]) <= 21
        cut = op.Track(3.0, 20, 1, 3, 1.0)
        cut.load(text)
    assert a + whole.end() == b + cut.end() and len(a) > 100


class Calls:
    """A handle and its states that count what is asked of them."""

    def __init__(self):
        self.timers, self.calls, self.held = set(), 0, {}

    def getValueState(self, name, schema):
        return State(self, name)

    getListState = getValueState

    def registerTimer(self, ts):
        self.calls += 1
        self.timers.add(ts)


class State:
    def __init__(self, owner, name):
        self.owner, self.name = owner, name

    def _at(self):
        self.owner.calls += 1
        return self.owner.held.setdefault(self.name, [])

    def exists(self):
        return bool(self._at())

    def get(self):
        rows = self._at()
        return iter(list(rows)) if self.name == "waiting" else rows[0]

    def appendValue(self, row):
        self._at().append(row)

    def put(self, rows):
        self._at()[:] = rows

    def update(self, row):
        self._at()[:] = [row]

    def clear(self):
        self._at().clear()


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_record_costs_a_few_calls_and_not_some_for_each_reading():
    rng = random.Random(5)
    xs = [round(min(100, rng.gauss(95, 4)), 1) for _ in range(2000)]
    pdf = pd.DataFrame({"ts_ms": [1000 * (t + 1) for t in range(2000)], "id": range(2000), "spo2": xs})
    handle, p = Calls(), op.Desaturations(3.0, 20, 1, 3, 1.0, 60_000)
    p.init(handle)
    out = []
    for mark, rows in ((0, pdf[:1200]), (900_000, pdf[1200:]), (5_000_000, pdf[:0])):  # the second batch comes while 300 readings wait
        for f in p.handleInputRows((7,), iter([rows.sample(frac=1.0, random_state=1)]), At(mark)):
            out += f.values.tolist()
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            for f in p.handleExpiredTimer((7,), At(mark), None):
                out += f.values.tolist()
    track = op.Track(3.0, 20, 1, 3, 1.0)
    want = [e for x in xs for e in track.feed(x)] + track.end()
    assert [tuple(e[1:]) for e in out] == want and len(want) > 50
    assert not handle.held["waiting"] and not handle.held["track"] and not handle.timers
    assert handle.calls < 60
