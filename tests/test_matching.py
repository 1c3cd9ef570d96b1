"""Greedy matching, iterations, streams and splits against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from pulsegrid.operators import catalog, evaluation, events, fiducials, screens
from pulsegrid.streaming import windows


def greedy(rule, tolerance, detected, truth):
    asks, held = (sorted(detected), sorted(truth)) if rule != "after" else (sorted(truth), sorted(detected))
    used, iou = set(), []
    for a in asks:
        best = None
        for j, b in enumerate(held):
            if j in used:
                continue
            if rule == "edges":
                score = abs(a[0] - b[0]) + abs(a[1] - b[1]) if abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance else None
            elif rule == "overlap":
                both = min(a[1], b[1]) - max(a[0], b[0])
                score = -both if both > 0 and both >= tolerance else None
            else:
                score = b[0] - a[0] if 0 <= b[0] - a[0] <= tolerance else None
            if score is not None and (best is None or score < best[0]):
                best = (score, j)
        if best:
            used.add(best[1])
            b = held[best[1]]
            iou.append(max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / max(max(a[1], b[1]) - min(a[0], b[0]), 1e-12))
    return len(used), float(np.mean(iou)) if iou else 0.0


@pytest.mark.parametrize(("rule", "tolerance"), [("edges", 1.0), ("overlap", 0.5), ("after", 1.5)])
def test_interval_matching(spark, rule, tolerance):
    rng = random.Random(hash(rule) % 97)
    make = lambda: [(r, s := rng.randrange(400) / 4, s + rng.randrange(1, 12) / 4) for r in range(6) for _ in range(rng.randrange(40))]
    d, t = make(), make()
    schema = "record long, start double, end double"
    got = {r.record: r for r in events.match_intervals(spark.createDataFrame(d, schema), spark.createDataFrame(t, schema), rule, tolerance).collect()}
    for k in {r[0] for r in d + t}:
        a, b = [x[1:] for x in d if x[0] == k], [x[1:] for x in t if x[0] == k]
        tp, iou = greedy(rule, tolerance, a, b)
        assert (got[k].tp, got[k].fp, got[k].fn) == (tp, len(a) - tp, len(b) - tp)
        assert abs(got[k].mean_iou - iou) < 1e-6


def test_closure_with_circles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (9, 9), (1, 2)]
    got = {tuple(r) for r in catalog.closure(spark.createDataFrame(edges, "tool long, needs long")).collect()}
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c} - want
        if not more:
            break
        want |= more
    assert got == want
    assert catalog.closure(spark.createDataFrame([], "tool long, needs long")).count() == 0


def test_split_takes_the_first_by_hash(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for i in range(400)] + [(900, "c", "z")]
    got = {r.id: r.split for r in evaluation.hash_split(spark.createDataFrame(rows, "id long, task string, modality string"), "s").collect()}
    for key in {r[1:] for r in rows}:
        mine = sorted((hashlib.sha256(":".join(["s", str(i), *filter(None, (t, m))]).encode()).hexdigest(), i) for i, t, m in rows if (t, m) == key)
        n = len(mine)
        held, dev = (max(1, round(0.2 * n)) if n >= 5 else 0), (max(1, round(0.1 * n)) if n >= 8 else 0)
        assert [got[i] for _, i in mine] == ["held_out"] * held + ["dev"] * dev + ["train"] * (n - held - dev)


def test_a_stream_gives_all_epochs_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    whole = []
    for part in range(3):
        rows = [(i, rng.randrange(5), rng.choice("ab"), float(rng.randrange(9)), 86_400 * rng.randrange(6) + i) for i in range(part * 50, part * 50 + 50)]
        whole += rows
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").selectExpr("event_id", "user_id", "event_type", "value", "cast(timestamp_seconds(s) as timestamp_ntz) as ts")
        df.coalesce(1).write.parquet(str(tmp_path / f"events.parquet{part}"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet0")).schema
    stream = windows.event_stream(spark, str(tmp_path), schema)
    got = {(r.start_us, r.event_type): (r.n, r.mean_value) for r in windows.run_available(windows.epochs(stream.withWatermark("ts", "300 days")), ["start_us", "event_type"]).collect()}
    want = {}
    for _, _, kind, v, s in whole:
        want.setdefault((s // 86_400 * 86_400_000_000, kind), []).append(v)
    assert got == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}


def test_retrieval_boosts_names_and_fills_by_modality(spark):
    tools = [(1, "ecg_peaks", "ecg", "finds peaks"), (2, "ecg_rate", "ecg", "rate of peaks peaks"), (3, "ppg_peaks", "ppg", "peaks peaks peaks"), (4, "any_quality", "any", "quality"), (5, "ecg_axis", "ecg", "axis")]
    asked = [(1, "peaks please", "ecg"), (2, "peaks", None), (3, "nothing here", "ecg")]
    got = evaluation.retrieve(spark.createDataFrame(asked, "q long, text string, modality string"), spark.createDataFrame(tools, "id long, name string, modality string, text string"), 3)
    order = {}
    for r in sorted(got.collect(), key=lambda r: (r.q, r.rank)):
        order.setdefault(r.q, []).append(r.id)
    assert order == {1: [2, 1, 4], 2: [3, 2, 1], 3: [4, 5, 1]}


def test_pulse_points_of_a_known_wave(spark):
    """A pulse with its foot at 2, top at 6 and second top at 12; its slope, over two samples, is upward again at 11."""
    one = [1, 0.5, 0, 2, 5, 8, 9, 7, 5, 4, 3, 3.5, 4, 3, 2, 1.5]
    rows = [(1, i, float(v)) for i, v in enumerate(one * 4)]
    samples = spark.createDataFrame(rows, "record long, idx long, x double")
    beats = fiducials.tops(samples, 4)
    got = [tuple(r)[2:] for r in sorted(fiducials.pulse_fiducials(samples, beats, 16.0).collect())]
    assert got[:3] == [(2 + 16 * k, 6 + 16 * k, 11 + 16 * k, 12 + 16 * k) for k in range(3)]
    shape = fiducials.morphology_summary(fiducials.pulse_morphology(samples, beats, 16.0)).first()
    assert (shape.pulses, shape.amplitude, shape.rise, shape.slope) == (4, 9.0, 0.25, 36.0)


def test_delimited_files_come_back(spark, tmp_path):
    from pulsegrid.sources import files

    rows = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, None, [])], "i long, x double, tags array<string>")
    files.write_delimited(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("i").collect()
    assert [tuple(r) for r in back] == [("1", "0.5", '["a","b"]'), ("2", None, "[]")]


def test_cascade_takes_the_first_method_with_a_value(spark):
    d = lambda rows: spark.createDataFrame(rows, "record long, value double")
    got = {tuple(r) for r in screens.cascade(("a", d([(1, None), (2, 5.0)])), ("b", d([(1, 3.0), (2, 4.0)])), ("c", d([(3, 1.0)]))).collect()}
    assert got == {(1, "b", 3.0), (2, "a", 5.0), (3, "c", 1.0)}
