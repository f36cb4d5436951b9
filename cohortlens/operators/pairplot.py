"""Data of a pair matrix coloured by cluster: density curves and histograms per cluster and measure.

All curves of all clusters come from the same passes: quartiles of every
(cluster, measure), one aggregation for counts, spreads and ranges, one for the
weights on each curve's own grid, and a kernel sum of at most ``grid`` points
per curve, made where the curve's weights lie. Nothing but the per-curve
parameters (clusters x measures rows) passes through the driver.

Defined results: null measures are left out of their curve; a null cluster is
no cluster; a curve of one value has its bandwidth from that value's size and
unit steps; histogram bins span the measure's range over all clusters, a value
within 1e-9 of a bin's lower edge belongs to it, a constant measure falls into
bin 0; empty bins have no row; an empty table has no curves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.density import GRID, bandwidth
from cohortlens.operators.quantile import grouped_quantiles
from cohortlens.session import ship_package

BINS = 30
MAX_CURVES = 100_000        # clusters x measures whose parameters are broadcast


def _long(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("bigint").alias("cluster"),
                                                     *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.unpivot("cluster", list(cols), "name", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def density_by_group(df: DataFrame, group: str, cols: Sequence[str], grid: int = GRID) -> DataFrame:
    """(cluster, name, i, x, density): a Gaussian kernel curve per cluster and measure, each on its own grid."""
    ship_package(df.sparkSession)
    cols = list(cols)
    long = _long(df, group, cols)
    stats = (long.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                                 F.min("v").alias("lo"), F.max("v").alias("hi"))
             .limit(MAX_CURVES + 1).collect())
    if len(stats) > MAX_CURVES:
        raise ValueError(f"over {MAX_CURVES} curves: their parameters would outgrow the broadcast")
    q = grouped_quantiles(df.where(F.col(group).isNotNull()), group, cols, [0.25, 0.75]) if stats else {}
    spec = []
    for r in stats:
        iqr = q[(r["cluster"], r["name"], 0.75)] - q[(r["cluster"], r["name"], 0.25)]
        spec.append((r["cluster"], r["name"], r["n"], bandwidth(r["sd"] or 0.0, iqr, r["n"], float(r["lo"])), float(r["lo"]),
                     (float(r["hi"]) - float(r["lo"])) / (grid - 1) or 1.0))
    params = df.sparkSession.createDataFrame(spec, "cluster bigint, name string, n bigint, bw double, lo double, step double")
    pos = (F.col("v") - F.col("lo")) / F.col("step")
    at = F.least(F.floor(pos), F.lit(grid - 2)).cast("int")
    split = (long.join(F.broadcast(params), ["cluster", "name"])         # MAX_CURVES rows at most
             .select("cluster", "name", "n", "bw", "lo", "step", at.alias("i"), (pos - at).alias("f")))
    weights = (split.select("cluster", "name", "n", "bw", "lo", "step", F.explode(F.array(
        F.struct(F.col("i").alias("i"), (1 - F.col("f")).alias("w")),
        F.struct((F.col("i") + 1).alias("i"), F.col("f").alias("w")))).alias("p"))
        .groupBy("cluster", "name", "n", "bw", "lo", "step", "p.i").agg(F.sum("p.w").alias("w")))

    def curve(key, table):
        cluster, name, n, bw, lo, step = (k.as_py() for k in key)
        w = np.zeros(grid)
        w[table.column("i").to_numpy()] = table.column("w").to_numpy()
        xs = lo + step * np.arange(grid)
        y = np.exp(-0.5 * ((xs[:, None] - xs[None, :]) / bw) ** 2) @ w / (math.sqrt(2 * math.pi) * n * bw)
        return pa.table({"cluster": np.full(grid, cluster), "name": [name] * grid, "i": np.arange(grid, dtype=np.int32),
                         "x": xs, "density": y})

    return weights.groupBy("cluster", "name", "n", "bw", "lo", "step").applyInArrow(
        curve, "cluster bigint, name string, i int, x double, density double")


def histogram_by_group(df: DataFrame, group: str, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """(cluster, name, bin, n): counts in ``bins`` equal bins over each measure's range of all clusters."""
    long = _long(df, group, cols)
    span = long.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.round((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 9)), F.lit(bins - 1))).cast("int")
    # a row per measure
    return (long.join(F.broadcast(span), "name").groupBy("cluster", "name", at.alias("bin"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
