"""Standardisation, correlation, PCA, VIF and linear models.

Every statistic is one aggregation pass over the table (Spark does partial
aggregation per task); only d x d matrices come to the driver, where numpy
does the eigen-decomposition / inversion.  Row-level outputs (z-scores, PC
scores) are plain column expressions with the small results as literals, so
they stay inside whole-stage codegen and need no join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import safe_corr

from cohortlens.schema import ID, MEASURES


# --- moments -------------------------------------------------------------

def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float | None]]:
    """{col: (mean, sample sd)} in one pass."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def zscore(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """Whole-table z-score (sample sd, like R's ``scale``).

    A constant column (sd 0) becomes NULL instead of raising under ANSI mode.
    """
    mom = column_moments(df, cols)
    out = {}
    for c in cols:
        m, s = mom[c]
        if m is None or s is None or s == 0 or s != s:
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def group_zscore(long: DataFrame, group: str = "name", value: str = "value",
                 out: str = "value_scale") -> DataFrame:
    """z-score within each group of a long table.

    groupBy + broadcast join of the per-group (mean, sd) instead of a window:
    a window partitioned by a dozen measure names would run in a dozen tasks
    with no partial aggregation.
    """
    stats = long.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    # one row per group (a measure name): bounded by the column count.
    j = long.join(F.broadcast(stats), group)
    return j.withColumn(out, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def total_ss(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """(n - 1) * sum of column variances: the k = 1 within-cluster sum of squares."""
    var_sum = sum((F.var_samp(c) for c in cols[1:]), F.var_samp(cols[0]))
    return df.agg(((F.count(F.lit(1)) - 1) * var_sum).alias("total_ss"))


# --- correlation ---------------------------------------------------------

def corr_values(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlation matrix (d x d) from one aggregation of d(d-1)/2 pairs."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    row = df.agg(*[safe_corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else None
    r = np.eye(d)
    for i, j in pairs:
        v = row[f"c{i}_{j}"]
        r[i, j] = r[j, i] = np.nan if v is None else v
    return r


def corr_long(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """(var_x, var_y, i, j, r): every ordered pair including the diagonal."""
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    stats = df.agg(*[safe_corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])
    # The 1-row statistics row is unpivoted into pairs: no join, no cross product.
    exprs = []
    for i in range(d):
        for j in range(d):
            if i == j:
                rv = F.lit(1.0)
            else:
                a, b = min(i, j), max(i, j)
                rv = F.col(f"c{a}_{b}")
            exprs.append(F.struct(F.lit(cols[i]).alias("var_x"), F.lit(cols[j]).alias("var_y"),
                                  F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"),
                                  rv.cast("double").alias("r")))
    return stats.select(F.explode(F.array(*exprs)).alias("p")).select("p.*")


def corr_triangle(corr: DataFrame, upper: bool = True) -> DataFrame:
    """Upper (i <= j) or lower (i >= j) triangle, diagonal included."""
    return corr.where(F.col("i") <= F.col("j")) if upper else corr.where(F.col("i") >= F.col("j"))


# --- principal components ------------------------------------------------

def pca_from_corr(r: np.ndarray):
    """Eigen-decomposition of a correlation matrix, largest first.

    Sign rule: the largest-magnitude loading of each component is positive,
    so results do not depend on the solver's arbitrary signs.
    """
    vals, vecs = np.linalg.eigh(r)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for k in range(vecs.shape[1]):
        i = int(np.argmax(np.abs(vecs[:, k])))
        if vecs[i, k] < 0:
            vecs[:, k] = -vecs[:, k]
    return np.clip(vals, 0.0, None), vecs


class PCAFit:
    """PCA of the correlation matrix (centred and scaled, like prcomp(scale.=TRUE))."""

    def __init__(self, df: DataFrame, cols: Sequence[str] = MEASURES):
        self.cols = list(cols)
        self.moments = column_moments(df, self.cols)
        self.corr = corr_values(df, self.cols)
        self.eigenvalues, self.rotation = pca_from_corr(self.corr)
        self.n = df.count()

    @property
    def sdev(self) -> np.ndarray:
        return np.sqrt(self.eigenvalues)

    def variance_table(self, spark) -> DataFrame:
        """(component, sdev, proportion, cumulative)."""
        tot = float(self.eigenvalues.sum())
        cum = 0.0
        rows = []
        for k, ev in enumerate(self.eigenvalues):
            cum += ev / tot
            rows.append((f"PC{k + 1}", k + 1, float(np.sqrt(ev)), float(ev / tot), float(cum)))
        return spark.createDataFrame(rows, "component string, k int, sdev double, proportion double, cumulative double")

    def loadings_table(self, spark) -> DataFrame:
        """(variable, component, loading) long form of the rotation matrix."""
        rows = [(v, f"PC{k + 1}", float(self.rotation[i, k]))
                for i, v in enumerate(self.cols) for k in range(len(self.cols))]
        return spark.createDataFrame(rows, "variable string, component string, loading double")

    def score_columns(self, n_components: int | None = None):
        """PC score expressions: sum_j z_j * v_jk, z from the fitted moments."""
        k_max = n_components or len(self.cols)
        z = []
        for c in self.cols:
            m, s = self.moments[c]
            z.append((F.col(c) - F.lit(m)) / F.lit(s))
        out = []
        for k in range(k_max):
            e = None
            for i, zc in enumerate(z):
                t = zc * F.lit(float(self.rotation[i, k]))
                e = t if e is None else e + t
            out.append(e.alias(f"PC{k + 1}"))
        return out

    def scores(self, df: DataFrame, keep: Sequence[str] = (ID,), n_components: int | None = None) -> DataFrame:
        return df.select(*keep, *self.score_columns(n_components))

    def biplot(self, df: DataFrame, keep: Sequence[str] = (ID,)) -> tuple[DataFrame, DataFrame]:
        """Biplot coordinates of PC1-2: scaled scores and stretched loadings."""
        lam = self.sdev[:2] * np.sqrt(self.n)
        sc = self.scores(df, keep, 2)
        sc = sc.select(*keep, (F.col("PC1") / F.lit(lam[0])).alias("x"), (F.col("PC2") / F.lit(lam[1])).alias("y"))
        rows = [(v, float(self.rotation[i, 0] * lam[0]), float(self.rotation[i, 1] * lam[1]))
                for i, v in enumerate(self.cols)]
        arrows = df.sparkSession.createDataFrame(rows, "variable string, x double, y double")
        return sc, arrows


# --- multicollinearity ---------------------------------------------------

def vif(df: DataFrame, response: str, predictors: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation factor per predictor: diagonal of the inverse
    correlation matrix of the predictors (= 1 / (1 - R^2_j))."""
    r = corr_values(df, predictors)
    value, vec = np.linalg.eigh(np.nan_to_num(r, nan=0.0))
    low = value < 1e-10 * max(1.0, value[-1])
    # predictors within an exact linear dependency have no finite factor; the others keep theirs
    tied = (np.abs(vec[:, low]) > 1e-6).any(axis=1)
    inverse = (vec[:, ~low] / value[~low]) @ vec[:, ~low].T
    constant = len(r) > 1 and np.isnan(r).sum(axis=1) == len(r) - 1
    constant = np.broadcast_to(constant, len(r))
    return [(p, float("nan") if constant[i] else float("inf") if tied[i] else float(inverse[i, i]))
            for i, p in enumerate(predictors)]


def vif_table(df: DataFrame, response: str = "care_contacts",
              predictors: Sequence[str] | None = None) -> DataFrame:
    preds = list(predictors) if predictors is not None else [c for c in MEASURES if c != response]
    rows = vif(df, response, preds)
    out = df.sparkSession.createDataFrame(rows, "variable string, vif double")
    return out.withColumn("band", vif_band(F.col("vif")))


def vif_band(v):
    """1 (within rounding): none; up to 5: moderate; above: problematic; NULL without a value."""
    return (F.when(F.isnan(v), F.lit(None).cast("string"))
            .when(v <= 1.000001, F.lit("none"))
            .when(v <= 5.0, F.lit("moderate"))
            .otherwise(F.lit("problematic")))


def linear_model(df: DataFrame, response: str, predictors: Sequence[str]) -> list[tuple[str, float]]:
    """Least-squares coefficients from centred cross-moments (one pass)."""
    cols = [response, *predictors]
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    means = np.array([row[f"m{i}"] for i in range(d)])
    beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    intercept = means[0] - float(beta @ means[1:])
    return [("(Intercept)", float(intercept))] + [(p, float(b)) for p, b in zip(predictors, beta)]
