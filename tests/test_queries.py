"""Every query with SQL against DuckDB on the small tables; the others must run."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from pulsegrid import plans

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
plans.load()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in got.collect()]
    if name not in plans.SQL:
        assert rows
        return
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(names) == sorted(got.columns)
    a, b = _rows(got.columns, rows), _rows(names, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, (int, float)) and abs(u - v) <= 2e-6 * max(1, abs(v))), (name, x, y)


def test_names_are_documented():
    assert set(plans.SQL) <= set(plans.QUERIES)
