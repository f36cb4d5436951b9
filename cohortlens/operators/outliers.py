"""Per-measure 99th-percentile outlier rule.

A person is an outlier when any measure is strictly above that measure's
99th percentile.  The wide form (``remove_outliers``) needs no join at all:
one quantile pass, then a row filter with the thresholds as literals.  The
long form (``outlier_ids``) keeps the original unpivot / filter / distinct
shape and is used as a cross-check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.quantile import exact_quantiles
from cohortlens.schema import ID, MEASURES, OUTLIER_QUANTILE


def measure_quantiles(df: DataFrame, cols: Sequence[str] = MEASURES,
                      p: float = OUTLIER_QUANTILE) -> dict[str, float]:
    q = exact_quantiles(df, cols, [p])
    return {c: q[(c, p)] for c in cols}


def quantile_table(df: DataFrame, cols: Sequence[str] = MEASURES,
                   p: float = OUTLIER_QUANTILE, alias: str = "quantile_99") -> DataFrame:
    """(name, quantile_99): one row per measure."""
    q = measure_quantiles(df, cols, p)
    return df.sparkSession.createDataFrame([(c, q[c]) for c in cols], f"name string, {alias} double")


def outlier_ids(df: DataFrame, cols: Sequence[str] = MEASURES, p: float = OUTLIER_QUANTILE,
                key: str = ID) -> DataFrame:
    """Distinct persons with any measure strictly above its quantile."""
    q = quantile_table(df, cols, p)
    long = df.unpivot([key], list(cols), "name", "value")
    # q has one row per measure: a bounded broadcast.
    return (long.join(F.broadcast(q), "name")
            .where(F.col("value") > F.col("quantile_99"))
            .select(key).distinct())


def remove_outliers(df: DataFrame, cols: Sequence[str] = MEASURES, p: float = OUTLIER_QUANTILE) -> DataFrame:
    """Rows with no measure above its quantile (the ``org`` column, if any, is kept)."""
    q = measure_quantiles(df, cols, p)
    bad = None
    for c in cols:
        if q[c] is None:
            continue
        t = F.col(c) > F.lit(q[c])
        bad = t if bad is None else (bad | t)
    # NULL measures never count as "above" (coalesce keeps the row like R's filter would drop NA).
    return df if bad is None else df.where(~F.coalesce(bad, F.lit(False)))


def remove_outliers_antijoin(df: DataFrame, cols: Sequence[str] = MEASURES,
                             p: float = OUTLIER_QUANTILE, key: str = ID) -> DataFrame:
    """Same result through the long form and an anti-join (original shape)."""
    return df.join(outlier_ids(df, cols, p, key), key, "left_anti")
