"""Model-fitting stages shared by several queries (memoised per session)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import kmeans as km
from cohortlens.operators import kmeans_many as kk
from cohortlens.operators.sampling import exact_sample
from cohortlens.plans import prepare as P
from cohortlens.schema import DBSCAN_MIN_PTS, EVAL_FRACTION, EVAL_SEED, ID, KMEANS_SETTINGS, MEASURES
from cohortlens.session import data_version

LLOYD_STEPS = 3


def lloyd_labelled(spark: SparkSession, d: str, k: int = 6, seed: int = 123) -> DataFrame:
    """The scaled table with its label after a fixed number of Lloyd updates from md5-chosen start rows.

    Labels come from the very rows, so they are stored beside the measures and
    no later step joins them back.
    """
    def build():
        x = P.scaled(spark, d)
        return km.assign(x, MEASURES, lloyd_centres(spark, d, k, seed)).select(ID, "cluster", *MEASURES)
    return P.stage(spark, d, f"lloyd_{k}_{seed}", build)


def lloyd_labels(spark: SparkSession, d: str, k: int = 6, seed: int = 123) -> DataFrame:
    return lloyd_labelled(spark, d, k, seed).select(ID, "cluster")


def lloyd_centres(spark: SparkSession, d: str, k: int = 6, seed: int = 123):
    x = P.scaled(spark, d)
    start = km.start_rows(x, MEASURES, [seed], k)[seed]
    return km.fixed_steps(x, MEASURES, start, LLOYD_STEPS)


def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation subsample of the scaled table (exact size, seed 123)."""
    return P.stage(spark, d, "eval_sample",
                   lambda: exact_sample(P.scaled(spark, d), EVAL_FRACTION, EVAL_SEED))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, e0, e1, ...) with the embedding as double columns, as wide as the vectors are."""
    from cohortlens.sources.tables import read_table
    def build():
        e = read_table(spark, d, "embeddings")
        low, width = e.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != width:
            raise ValueError(f"vectors of {low} to {width} components")
        return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
    return P.stage(spark, d, "embeddings", build)


def emb_cols(e: DataFrame) -> list[str]:
    return [c for c in e.columns if c not in ("vec_id", "label")]


_FITS: dict = {}


def _fitted(spark: SparkSession, d: str, name: str, build):
    """A fit made once per session and version of the data."""
    key = (spark.sparkContext.applicationId, d, data_version(spark, d), name)
    if key not in _FITS:
        _FITS[key] = build()
    return _FITS[key]


def leaves(spark: SparkSession, d: str):
    """The scaled table dealt to bounded leaves."""
    from cohortlens.operators import leaves as lv
    return _fitted(spark, d, "leaves", lambda: lv.grow(P.scaled(spark, d), MEASURES))


def knn(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, knn_dist, visits) on the scaled table."""
    from cohortlens.operators import density_scan as ds
    return P.stage(spark, d, "knn", lambda: ds.knn_leaves(P.scaled(spark, d), MEASURES, DBSCAN_MIN_PTS, tree=leaves(spark, d)))


def dbscan_fit(spark: SparkSession, d: str):
    """DBSCAN on the scaled table, over leaves."""
    from cohortlens.operators import density_scan as ds
    return _fitted(spark, d, "dbscan", lambda: ds.dbscan_leaves(P.scaled(spark, d), MEASURES, tree=leaves(spark, d)))


def dbscan_labelled(spark: SparkSession, d: str) -> DataFrame:
    """The scaled table with the labels of DBSCAN: (person_id, measures, cluster, is_core)."""
    return dbscan_fit(spark, d).labels


def dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, cluster, is_core) of DBSCAN on the scaled table."""
    return dbscan_labelled(spark, d).select(ID, "cluster", "is_core")


def stated_sweep(spark: SparkSession, d: str) -> km.KMeansSweep:
    """K-means of every k with the study's own starts and limits."""
    return _fitted(spark, d, "stated", lambda: kk.fit_many(P.scaled(spark, d), MEASURES, KMEANS_SETTINGS, seed=123))


def hartigan_rows(spark: SparkSession, d: str) -> DataFrame:
    """The scaled table with its label of k = 6 after Lloyd (stated setting) and transfers."""
    def build():
        starts, most = KMEANS_SETTINGS[6]
        return kk.hartigan(P.scaled(spark, d), MEASURES, 6, starts, most).rows
    return P.stage(spark, d, "hartigan6", build)


def mixture_grid(spark: SparkSession, d: str):
    """BIC grid: G = 1..12 x 14 covariance models on the scaled table."""
    from cohortlens.operators import mixture as mx
    from cohortlens.schema import GRID_MODELS, MIXTURE_GROUPS
    return _fitted(spark, d, "grid", lambda: mx.fit_grid(P.scaled(spark, d), MEASURES, MIXTURE_GROUPS, GRID_MODELS,
                                                             start="agglomerative"))


def chosen_mixture(spark: SparkSession, d: str):
    """The study's chosen model (EEV, G = 6)."""
    from cohortlens.operators import mixture as mx
    from cohortlens.schema import CHOSEN_MIXTURE
    model, g = CHOSEN_MIXTURE
    return _fitted(spark, d, "chosen", lambda: mx.fit_grid(P.scaled(spark, d), MEASURES, [g], [model], start="agglomerative")[(g, model)])


def lpa_labelled(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, cluster, uncertainty, log_map, measures) of the chosen mixture: labels beside the rows they come from."""
    from cohortlens.operators import mixture as mx
    return P.stage(spark, d, "lpa", lambda: mx.classify(P.scaled(spark, d), MEASURES, chosen_mixture(spark, d), keep=True))


def lpa_labels(spark: SparkSession, d: str) -> DataFrame:
    return lpa_labelled(spark, d).drop(*MEASURES)


def kmeans_labelled(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, cluster, measures): K-means with 6 centres by the study's stated setting: 10 starts, at most 1000 iterations."""
    def build():
        x = P.scaled(spark, d)
        starts, most = KMEANS_SETTINGS[6]
        fit = kk.fit_many(x, MEASURES, {6: (starts, most)}, seed=123)
        return km.assign(x, MEASURES, fit.best(6).centres).select(ID, "cluster", *MEASURES)
    return P.stage(spark, d, "kmeans6", build)


def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    return kmeans_labelled(spark, d).select(ID, "cluster")
