"""Steps that a task holds in memory are dealt by the number of rows, not by the session's number of partitions."""

import random
import re

import numpy as np

from pulsegrid.operators import catalog, components, evaluation, events, image_scale, wave_features


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_dealt_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(image_scale, "TASK_PIXELS", 20)
    rows = [(1, x, y, 100) for x in range(0, 40, 10) for y in range(100)] * 2 + [(1, 3, 3, 240)]
    sizes = spark.createDataFrame([(1, 40, 100)], "image long, width int, height int")
    profiles = image_scale.profiles(spark.createDataFrame(rows, "image long, x int, y int, grey int"), sizes)
    dealt = {int(n) for n in re.findall(r"hashpartitioning\(image#\d+L, axis#\d+, at#\d+L, (\d+)\)", plan(profiles))}
    assert dealt == {80}
    assert [v for v in profiles.first()["values"] if v] == [1.0] * 4


def test_entries_are_dealt_by_pairs_with_queries(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "TASK_PAIRS", 10)
    asked = spark.createDataFrame([(q, f"red w{q % 3} shared gold", "ecg" if q % 2 else None) for q in range(10)], "q long, text string, modality string")
    known = spark.createDataFrame([(i, f"name_{i} gold", "ECG", f"red w{i % 3} shared w{i % 3}") for i in range(40)] + [(90, None, None, None)], "id long, name string, modality string, text string")
    for found in (evaluation.tfidf_top(asked, known, 2), evaluation.retrieve(asked, known, 2), evaluation.replay(asked, known)):
        assert "hashpartitioning(id" in plan(found) and {int(n) for n in re.findall(r"hashpartitioning\(id#\d+L, (\d+)\)", plan(found))} == {41}
    best = {(r.q, r.rank): r for r in evaluation.retrieve(asked, known, 2).collect()}
    assert [best[4, k].id for k in (1, 2)] == [1, 10] and len(best) == 20
    # gold is a word of names only: it adds the boost, though no text holds it
    plain = {(r.q, r.rank): r for r in evaluation.retrieve(asked, known, 2, 0.0).collect()}
    assert {round(best[k].score - plain[k].score, 6) for k in best} == {0.5}


def test_closure_makes_a_path_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "dealt", lambda df, rows, each, *keys: made.append((keys, df.count())) or df, raising=False)
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)], "tool long, needs long")
    got = {tuple(r) for r in catalog.closure(chain).collect()}
    assert got == {(i, j) for i in range(1, 41) for j in range(i)}
    # lengths below 1, 2, 4 ... 64, each pair of a chain once: no round sees more rows than it keeps
    assert [n for keys, n in made if keys == ("tool", "needs")][1::2] == [sum(41 - d for d in range(1, min(2**k, 41))) for k in range(1, 7)]


def test_runs_are_joined_in_tiles(spark, monkeypatch):
    rng = random.Random(3)
    pixels = spark.createDataFrame([(f"i{i}", x, y) for i in range(3) for x in range(40) for y in range(40) if rng.random() < 0.6], "image string, x int, y int").cache()
    edges = components.touching_runs(components.pixel_runs(pixels)).cache()
    stars = sorted(map(tuple, components.connected(edges).collect()))
    for bits, chunk in ((1, 7), (3, 40)):
        monkeypatch.setattr(components, "TILE_BITS", bits)
        monkeypatch.setattr(components, "TILE_EDGES", chunk)
        assert sorted(map(tuple, components.connected_in_tiles(edges).collect())) == stars
    # images that are smaller than a tile take no rounds
    monkeypatch.setattr(components, "TILE_BITS", 8)
    monkeypatch.setattr(components, "connected", None)
    assert components.components(pixels).count() > 3
    assert sorted(map(tuple, components.connected_in_tiles(edges).collect())) == stars and components.components(pixels.limit(0)).count() == 0


def test_events_are_matched_without_groups(spark):
    rng = random.Random(5)
    d, t = ([(r, rng.randrange(400) / 8) for r in (1, 2, None) for _ in range(150)] for _ in range(2))
    rows = lambda v: spark.createDataFrame(v, "record long, t double")
    got = events.match_events(rows(d + [(3, None), (4, 1.0)]), rows(t + [(3, None), (4, 1.5)]), 0.5)
    assert "FlatMapGroupsInPandas" not in plan(got)
    tp = {r.record: r.tp for r in got.collect()}

    def greedy(r):
        free, n = sorted(v for k, v in t if k == r), 0
        for x in sorted(v for k, v in d if k == r):
            near = [(abs(v - x), j) for j, v in enumerate(free) if abs(v - x) <= 0.5]
            if near:
                del free[min(near)[1]]
                n += 1
        return n

    assert tp == {1: greedy(1), 2: greedy(2), None: greedy(None), 3: 0, 4: 1}


def test_breathing_is_filtered_for_all_rows_at_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 64)).cumsum(axis=1)
    rows = wave_features.breathing_peaks(x, 2.5)
    assert len(rows) == 50 and [wave_features.breathing_peaks(v[None, :], 2.5)[0] for v in x] == rows
