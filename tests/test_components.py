"""Connected pixels and waveform areas against flood filling and plain loops."""

import os

import numpy as np
import pytest

from pulsegrid.operators import components as op
from pulsegrid.sources.scratch import Steps, written

PIXELS = "image long, x long, y long"


def flood(mask):
    """Parts of a mask, neighbours left, right, up and down."""
    label, parts = np.full(mask.shape, -1), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x] < 0:
            todo, label[y, x] = [(y, x)], len(parts)
            for a, b in todo:
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and label[c, d] < 0:
                        label[c, d] = len(parts)
                        todo.append((c, d))
            parts.append(np.array(todo))
    return parts


def picture(kind, rng, h=70, w=140):
    mask = np.zeros((h, w), bool)
    x = np.arange(w)
    if kind == "traces":
        for base, gap in ((15, 30), (50, 75)):
            for k in range(w):
                if abs(k - gap) > 2:
                    y = int(base + 9 * np.sin(k / 7))
                    mask[y - 2 : y + 3, k] = True
        mask[68, 5:130] = True  # an axis
        mask[2:6, 3:9] = True  # a letter
    if kind == "noise":
        mask = rng.random((h, w)) < 0.55
    if kind == "spiral":
        for k in range(0, 30, 2):
            mask[k : h - k, k] = mask[k : h - k, w - 1 - k] = mask[k, k : w - k] = mask[h - 1 - k, k : w - k] = True
            mask[k + 1, k] = False
            if k:
                mask[k, k - 1] = True
    if kind == "lines":
        mask[20, x % 3 > 0] = mask[21, x % 5 > 0] = mask[60, :] = True
    if kind == "dots":
        mask[5, 5] = mask[40, 100] = True
    return mask


def rows_of(masks):
    return [(i, int(x), int(y)) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]


def figures(part):
    y, x = part[:, 0], part[:, 1]
    d = {"x_min": x.min(), "x_max": x.max() + 1, "y_min": y.min(), "y_max": y.max() + 1, "n": len(y), "yc": y.mean(), "sd": y.std()}
    d["score"] = (d["x_max"] - d["x_min"]) * np.sqrt(d["n"]) * max(1, d["sd"]) / max(1, np.sqrt(d["y_max"] - d["y_min"]))
    return d


def traces(mask, least):
    found = [figures(p) for p in flood(mask)]
    return [d for d in found if d["n"] >= 12 and d["x_max"] - d["x_min"] >= least and d["sd"] >= max(1.5, mask.shape[0] * 0.006)]


def bands(mask):
    h, w = mask.shape
    hot = np.flatnonzero(mask.sum(axis=1) >= max(2, int(w * 0.006)))
    reach, on, out = max(2, int(h * 0.015)), np.zeros(h, bool), []
    for y in hot:
        on[max(0, y - reach) : y + reach + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        y, x = np.nonzero(mask[a:b])
        if b - a >= max(3, int(h * 0.015)) and len(x) >= 10 and np.ptp(x) + 1 >= max(20, int(w * 0.08)):
            out.append({"x_min": x.min(), "x_max": x.max() + 1, "y_min": a, "y_max": b, "n": len(x), "yc": (a + b) / 2, "score": (np.ptp(x) + 1) * np.sqrt(len(x)) / np.sqrt(b - a)})
    return out


def choose(found, policy, share):
    if policy == "top":
        return min(found, key=lambda d: d["yc"])
    if policy == "largest":
        return max(found, key=lambda d: d["score"])
    top = max(d["score"] for d in found)
    return max((d for d in found if d["score"] >= share * top), key=lambda d: (d["yc"], d["score"]))


def brute_area(mask, policy):
    h, w = mask.shape
    found = traces(mask, max(30, int(w * 0.12)))
    if found:
        c, margin = choose(found, policy, 0.25), max(8, int(h * 0.08))
        a, b = max(0, c["y_min"] - margin), min(h, c["y_max"] + margin)
        use = [d for d in found if a <= d["yc"] <= b or max(0, min(b, d["y_max"]) - max(a, d["y_min"])) >= max(3, int(0.15 * (d["y_max"] - d["y_min"])))]
        mode, n = "components", len(found)
    elif found := bands(mask):
        use, mode, n = [choose(found, policy, 0.35)], "row_band", len(found)
    else:
        y, x = np.nonzero(mask)
        use, mode, n = [{"x_min": x.min(), "x_max": x.max() + 1, "y_min": y.min(), "y_max": y.max() + 1}], "all", 0
    box = (max(0, min(d["x_min"] for d in use) - 4), min(w, max(d["x_max"] for d in use) + 4), max(0, min(d["y_min"] for d in use) - 4), min(h, max(d["y_max"] for d in use) + 4))
    picked = sum(d["n"] for d in use) if mode == "components" else mask[box[2] : box[3], box[0] : box[1]].sum()
    return (mode, n, 0 if mode == "all" else len(use), *map(int, box), round(mask.mean(), 6), round(picked / mask.size, 6), round((box[1] - box[0]) * (box[3] - box[2]) / mask.size, 6))


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(5)
    out = {i: picture(k, rng) for i, k in enumerate(("traces", "noise", "spiral", "lines", "dots"))}
    return out | {i: rng.random((40, 60)) < p for i, p in ((10, 0.3), (11, 0.6), (12, 0.9))}


def frame(spark, masks):
    rows = rows_of(masks)
    return spark.createDataFrame([*rows, *rows[:50], (None, 1, 1), (0, None, 3)], PIXELS).repartition(5)


@pytest.fixture(scope="module")
def labelled(spark, masks):
    """The runs of all masks, labelled once for the tests that follow."""
    return written(op.labelled_runs(frame(spark, masks)), "labelled")


@pytest.fixture
def known(labelled, monkeypatch):
    monkeypatch.setattr(op, "labelled_runs", lambda pixels: labelled)


def test_components(spark, masks, known):
    got = op.components(frame(spark, masks)).collect()
    got = {(r.image, r.first_x, r.first_y): tuple(r)[3:] for r in got}
    want = {(i, int(p[0, 1]), int(p[0, 0])): figures(p) for i, m in masks.items() for p in flood(m)}
    assert got.keys() == want.keys()
    for k, d in want.items():
        assert np.allclose(got[k], [d[c] for c in ("x_min", "x_max", "y_min", "y_max", "n", "yc", "sd")], atol=1e-6)


@pytest.mark.parametrize("policy", ["bottom", "top", "largest"])
def test_area(spark, masks, known, policy):
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in masks.items()], "image long, width int, height int")
    got = {r.image: tuple(r)[1:] for r in op.waveform_area(frame(spark, masks), sizes, policy).collect()}
    for i, m in masks.items():
        want = brute_area(m, policy)
        assert got[i][:7] == want[:7] and np.allclose(got[i][7:], want[7:], atol=2e-6), (i, got[i], want)
    assert {w[0] for w in got.values()} == {"components", "row_band", "all"}


def test_areas(spark, masks, known):
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in masks.items()], "image long, width int, height int")
    got = {}
    for r in op.waveform_areas(frame(spark, masks), sizes).collect():
        got.setdefault(r.image, {})[r.panel] = tuple(r)[2:]
    for i, m in masks.items():
        h, w = m.shape
        panels, least = [], max(20, int(w * 0.08))
        for d in sorted(traces(m, least), key=lambda d: d["yc"]):
            for p in panels:
                if abs(d["yc"] - np.mean([q["yc"] for q in p])) <= max(8, int(h * 0.08)):
                    p.append(d)
                    break
            else:
                panels.append([d])
        panels = panels or [[b] for b in bands(m) if b["x_max"] - b["x_min"] >= least]
        want = sorted((max(0, min(d["y_min"] for d in p) - 4), max(0, min(d["x_min"] for d in p) - 4), min(h, max(d["y_max"] for d in p) + 4), min(w, max(d["x_max"] for d in p) + 4), len(p), sum(d["n"] for d in p)) for p in panels)
        assert [(y0, x0, y1, x1, k, n) for k, x0, x1, y0, y1, n in (v for _, v in sorted(got.get(i, {}).items()))] == [tuple(map(int, t)) for t in want], i


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], PIXELS)
    assert op.components(empty).count() == op.waveform_area(empty).count() == op.waveform_areas(empty).count() == 0
    one = op.waveform_area(spark.createDataFrame([(1, 3, 2)], PIXELS)).collect()
    assert [tuple(r)[:8] for r in one] == [(1, "all", 0, 0, 0, 4, 0, 3)]


def test_parts_of_long_paths_and_stars(spark):
    edges = [(1, k, k + 1) for k in range(300)] + [(2, 0, k) for k in range(1, 400)] + [(3, 5, 5), (3, 7, 6), (3, 6, 7)]
    got = {(r.image, r.node): r.part for r in op.connected(spark.createDataFrame(edges, "image long, a long, b long")).collect()}
    assert all(got[1, k] == 0 for k in range(301)) and all(got[2, k] == 0 for k in range(400)) and got[3, 7] == 6 and (3, 5) not in got


def test_steps_delete_their_predecessor(spark):
    steps = Steps("t")
    steps.write(spark.range(3))
    first = steps.path
    assert steps.write(spark.range(4)).count() == 4 and not os.path.exists(first) and os.path.exists(steps.path)
