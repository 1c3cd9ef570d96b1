"""Interval matchings scan the pieces of records one after the other in a task: no group for each, pieces over several batches, records without a name."""

from pulsegrid.operators import events as op

SIDE = "record long, start double, end double"


def rows(record, n, step, late=0.0):
    return [(record, k * step + late, k * step + late + 0.4) for k in range(n)]


def test_pieces_stream_and_are_no_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = rows(1, 40, 10.0) + rows(2, 40, 0.5) + rows(None, 30, 10.0) + rows(3, 5, 10.0)
        b = rows(1, 40, 10.0, 0.1) + rows(2, 40, 0.5, 0.1) + rows(None, 20, 10.0, 0.1)
        d, t = spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE)
        want = {1: (40, 0, 0), 2: (40, 0, 0), None: (20, 10, 0), 3: (0, 5, 0)}
        for rule, tolerance in (("edges", 0.2), ("overlap", 0.1)):
            got = op.match_intervals(d, t, rule, tolerance)
            assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
            assert {r.record: (r.tp, r.fp, r.fn) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
