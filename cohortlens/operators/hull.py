"""Convex hull per cluster of 2-D projected points.

The hull of a union is the hull of the parts' hulls. Each task keeps, over all
its batches, the hull vertices of every cluster it holds and emits them once;
the partial hulls are then reduced in a tree, ``FANIN`` of them at a time, until
one is left per cluster. So a group never holds more than ``FANIN`` hulls,
however many tasks and rows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package, write_stage


def monotone_chain(pts: np.ndarray) -> np.ndarray:
    """Hull vertices in counter-clockwise order (Andrew's monotone chain)."""
    pts = np.unique(pts, axis=0)
    if len(pts) <= 2:
        return pts

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower, upper = [], []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(p)
    for p in pts[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(p)
    return np.array(lower[:-1] + upper[:-1])


FANIN = 32


def _partial(label, x, y):
    def fn(it):
        hulls: dict = {}
        for pdf in it:
            for c, g in pdf.groupby(label):
                pts = g[[x, y]].to_numpy(float)
                hulls[c] = monotone_chain(np.concatenate([hulls[c], pts]) if c in hulls else pts)
        for c, h in hulls.items():
            yield pd.DataFrame({label: c, x: h[:, 0], y: h[:, 1]})
    return fn


def _merge(label, x, y):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        h = monotone_chain(pdf[[x, y]].to_numpy(float))
        return pd.DataFrame({label: pdf[label].iloc[0], x: h[:, 0], y: h[:, 1], "_part": pdf["_part"].iloc[0] // FANIN})
    return fn


def _final(label, x, y):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        h = monotone_chain(pdf[[x, y]].to_numpy(float))
        return pd.DataFrame({label: pdf[label].iloc[0], "vertex": np.arange(len(h), dtype="int64"),
                             x: h[:, 0], y: h[:, 1]})
    return fn


def convex_hulls(df: DataFrame, label: str = "cluster", x: str = "x", y: str = "y") -> DataFrame:
    """(label, vertex, x, y): hull vertices per cluster, counter-clockwise."""
    ship_package(df.sparkSession)
    base = df.select(label, df[x].cast("double").alias(x), df[y].cast("double").alias(y))
    part = base.mapInPandas(_partial(label, x, y), f"{label} bigint, {x} double, {y} double")
    part = write_stage(part.withColumn("_part", F.spark_partition_id().cast("bigint")), "hull")
    most = part.agg(F.max("_part")).first()[0] or 0
    while most >= FANIN:
        part = write_stage(part.groupBy(label, F.floor(F.col("_part") / FANIN)).applyInPandas(
            _merge(label, x, y), f"{label} bigint, {x} double, {y} double, _part bigint"), "hull")
        most //= FANIN
    return part.drop("_part").groupBy(label).applyInPandas(_final(label, x, y),
                                             f"{label} bigint, vertex bigint, {x} double, {y} double")
