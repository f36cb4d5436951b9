"""Combining per-task partial sums of the iterative fits.

Each task of a K-means / EM pass adds up over all its batches and emits one
row per (fit, component) when it ends, so a pass makes tasks x components rows.
They are summed by a Spark ``groupBy``; the driver receives the final
per-component rows only. Sums of many measures go as cells, one row each: a
``groupBy`` with a hundred sums costs Spark a second for its plan alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(partials: DataFrame, keys: Sequence[str], values: Sequence[str]) -> list[dict]:
    rows = partials.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).collect()
    return [r.asDict() for r in rows]


def combine_cells(partials: DataFrame, size: int) -> np.ndarray:
    """Sums of (cell, v) as an array of ``size``; a cell that no task has is zero."""
    rows = partials.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows.column("cell").to_numpy()] = rows.column("v").to_numpy()
    return out
