"""Named queries over the stored tables: each an operator bound to its table, with the same in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_MODULES = ("rhythm", "signals", "oximetry", "motion", "pairing", "evaluation", "reports", "kernels", "streams", "catalog", "images", "fiducials", "screens", "wave_features", "components", "beat_detection", "scoring", "pixel_features", "image_scale", "multi_axis")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
