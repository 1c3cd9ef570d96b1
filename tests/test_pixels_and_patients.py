"""Pixel features against whole arrays, and patients with missing and odd sites."""

import numpy as np
import pytest

from pulsegrid.operators import patients, pixel_features


@pytest.mark.parametrize("tile", [1, 7, 256])
def test_features_equal_those_of_whole_images(spark, tile):
    rng = np.random.default_rng(tile)
    images = {k: rng.integers(0, 256, (23, 31, 3)) for k in (1, 2)}
    gone = {(1, 4, 5), (2, 7, 7)}
    rows = [(k, x, y, *map(int, a[y, x])) for k, a in images.items() for y in range(23) for x in range(31) if (k, x, y) not in gone]
    sizes = spark.createDataFrame([(1, 31, 23), (2, 31, 23)], "image long, width int, height int")
    df = spark.createDataFrame([*rows, (None, 1, 1, 1, 1, 1), (1, None, 1, 1, 1, 1)], "image long, x int, y int, r int, g int, b int").repartition(6)
    got = {(r.image, r.x, r.y): r for r in pixel_features.pixel_features(df, sizes, tile).collect()}
    assert len(got) == len(rows)
    for k, x, y, r, g, b in rows:
        v = got[k, x, y]
        grey = lambda a, c: images[k][c, a] / 255 @ [0.299, 0.587, 0.114]  # noqa: B023, E731
        up = abs(grey(x, y) - grey(x, y - 1)) if y and (k, x, y - 1) not in gone else 0
        left = abs(grey(x, y) - grey(x - 1, y)) if x and (k, x - 1, y) not in gone else 0
        r, g, b = r / 255, g / 255, b / 255
        want = [grey(x, y), 1 - grey(x, y), r, g, b, max(r, g, b) - min(r, g, b), b - max(r, g), r - max(g, b), y / 22, x / 30, up, left]
        assert np.allclose(tuple(v)[3:], want, atol=2e-6)


def test_one_shuffle_of_pixels(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1)], "image long, x int, y int, r int, g int, b int")
    sizes = spark.createDataFrame([(1, 2, 2)], "image long, width int, height int")
    plan = pixel_features.pixel_features(df, sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    physical = pixel_features.pixel_features(df, sizes)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(image#") - physical.count("ENSURE_REQUIREMENTS") <= 1


def test_rollup(spark):
    rows = [
        (1, [("AV", 0.9), ("pv ", 0.7), ("XX", 0.1), ("AV", 0.0), ("Mv", 0.8)]), (2, [("TV", 0.2)]), (3, [("XX", 0.9)]), (4, []), (5, None),
        (6, [("AV", 0.9), ("PV", 0.1)]), (7, [("AV", None), ("av", 0.6), (None, 0.9), ("PHC", float("nan"))]), (None, [("AV", 0.1)]),
    ]
    df = spark.createDataFrame(rows, "patient long, recordings array<struct<site: string, score: double>>")
    got = {r.patient: r for r in patients.patient_rollup(df).collect()}
    assert (got[1].used, got[1].missing, got[1].finding, got[1].strongest, got[1].confidence) == ("AV,PV,MV", "TV,Phc", "present", "AV", 0.72) and got[1].mean_score == 0.8
    assert (got[2].finding, got[2].confidence, got[2].spread) == ("absent", 0.6, 0.0)
    assert all((got[k].finding, got[k].n_sites, got[k].missing) == ("no_site", 0, "AV,PV,TV,MV,Phc") for k in (3, 4, 5))
    assert (got[6].finding, got[6].confidence) == ("abstain", 0.3) and (got[7].used, got[7].mean_score) == ("AV", 0.6) and len(got) == 8
    by = {r.site: r for r in patients.site_summary(df).collect()}
    assert by["AV"].patients == 4 and by["AV"].present_share == 0.75 and set(by) == {"AV", "PV", "MV", "TV"}
    assert patients.patient_rollup(df.limit(0)).count() == 0
