"""Registered queries: Gaussian mixture (latent profile) family."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import mixture as mx
from cohortlens.operators import reshape, stats
from cohortlens.plans import models as MD
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import query
from cohortlens.schema import GRID_MODELS, ID, MEASURES, MIXTURE_GROUPS, MODEL_NAMES
from cohortlens.sources.lookups import measure_lookup

M = MEASURES
D = len(M)


def _grid_rows(spark, d):
    grid = MD.mixture_grid(spark, d)
    return [(g, m, grid[(g, m)].bic(D)) for g in MIXTURE_GROUPS for m in GRID_MODELS]


@query("bic_grid")
def q_bic_grid(spark, d):
    grid = MD.mixture_grid(spark, d)
    rows = [(g, m, bic, grid[(g, m)].converged, grid[(g, m)].iterations, grid[(g, m)].reason)
            for g, m, bic in _grid_rows(spark, d)]
    return spark.createDataFrame(rows, "n_profiles int, model string, bic double, converged boolean, "
                                       "iterations int, reason string")


def _bic_wide(spark, d, column: str = "bic"):
    """A row per number of profiles, a column per model."""
    grid = MD.mixture_grid(spark, d)
    rows = [(g, m, grid[(g, m)].bic(D), grid[(g, m)].reason) for g in MIXTURE_GROUPS for m in GRID_MODELS]
    df = spark.createDataFrame(rows, "n_profiles int, model string, bic double, reason string")
    return df.groupBy("n_profiles").pivot("model", GRID_MODELS).agg(F.first(column))


@query("bic_long")
def q_bic_long(spark, d):
    """The wide table gathered into rows again; a model without BIC carries the reason."""
    def gathered(column):
        return _bic_wide(spark, d, column).unpivot("n_profiles", GRID_MODELS, "model", column)
    # 168 rows
    df = gathered("bic").join(gathered("reason"), ["n_profiles", "model"])
    return df.select(F.col("n_profiles").cast("double").alias("n_profiles"), "model", F.abs("bic").alias("val"), "bic", "reason")


@query("bic_wide")
def q_bic_wide(spark, d):
    names = dict(MODEL_NAMES)
    return _bic_wide(spark, d).select("n_profiles", *[F.col(m).alias(f"{m}: {names[m]}") for m in GRID_MODELS])


def _g1_sql():
    n = "count(*)"
    v = " + ".join(f"var_pop({c})" for c in M)
    lv = " + ".join(f"ln(2 * pi() * var_pop({c}))" for c in M)
    return O.chain("scaled") + f"""
SELECT 1 AS n_profiles, 'EII' AS model,
       round(2 * (-{n} * {D} / 2.0 * ln(2 * pi() * ({v}) / {D}) - {n} * {D} / 2.0) - {D + 1} * ln({n}), 3) AS bic
FROM scaled
UNION ALL
SELECT 1, 'VVI', round(2 * (-{n} / 2.0 * ({lv}) - {n} * {D} / 2.0) - {2 * D} * ln({n}), 3) FROM scaled"""


@query("bic_g1", _g1_sql())
def q_bic_g1(spark, d):
    fits = mx.fit_grid(P.scaled(spark, d), M, [1], ["EII", "VVI"])
    rows = [(1, m, round(fits[(1, m)].bic(D), 3)) for m in ["EII", "VVI"]]
    return spark.createDataFrame(rows, "n_profiles int, model string, bic double")


@query("lpa_assign")
def q_lpa_assign(spark, d):
    return MD.lpa_labels(spark, d).select(ID, "cluster")


@query("lpa_summary")
def q_lpa_summary(spark, d):
    fit = MD.chosen_mixture(spark, d)
    lab = MD.lpa_labels(spark, d)
    bic = fit.bic(D)
    icl = None if bic is None else bic + 2 * lab.agg(F.sum("log_map")).first()[0]
    rows = [(fit.model, fit.g, fit.loglik, fit.n, mx.n_params(fit.model, fit.g, D), bic, icl, fit.iterations)]
    return spark.createDataFrame(rows, "model string, g int, loglik double, n bigint, df int, bic double, "
                                       "icl double, iterations int")


@query("lpa_class_sizes")
def q_lpa_class_sizes(spark, d):
    return MD.lpa_labels(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _lpa_profiles(spark, d):
    x = stats.zscore(MD.lpa_labelled(spark, d), M)
    means = x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])
    rank = F.row_number().over(Window.orderBy("cluster"))   # one row per profile
    return means.select(F.concat(F.lit("Profile "), rank.cast("string")).alias("profile"),
                        *[F.round(c, 3).alias(c) for c in M])


@query("profile_means_lpa")
def q_profile_means_lpa(spark, d):
    return _lpa_profiles(spark, d)


@query("profile_long_lpa")
def q_profile_long_lpa(spark, d):
    long = reshape.unpivot_measures(_lpa_profiles(spark, d), ["profile"], M)
    return reshape.join_labels(long, measure_lookup(spark))
