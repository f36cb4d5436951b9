"""Registered queries: DBSCAN family, PCA / VIF / linear model, column summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortlens.functions.columns import safe_corr

from cohortlens.operators import dbscan as db
from cohortlens.operators import reshape, stats
from cohortlens.operators.quantile import exact_quantiles
from cohortlens.plans import models as MD
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import query
from cohortlens.plans.catalog_models import KM6, SCALED, dist2_sql
from cohortlens.schema import DBSCAN_EPS, DBSCAN_MIN_PTS, ID, MEASURES, ORG

M = MEASURES

# ---------------------------------------------------------------- DBSCAN family

PAIRS = SCALED + f""",
pairs AS (SELECT a.person_id AS id, b.person_id AS other, sqrt({dist2_sql('a', 'b')}) AS d
          FROM scaled a CROSS JOIN scaled b)"""


@query("knn_dist", PAIRS + f"""
SELECT id AS person_id, round(d, 6) AS knn_dist FROM (
  SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM pairs WHERE id <> other)
WHERE rn = {DBSCAN_MIN_PTS}""")
def q_knn_dist(spark, d):
    return MD.knn(spark, d).select(ID, "knn_dist")


@query("dbscan_core", PAIRS + f"""
SELECT id AS person_id, CAST(count_if(d <= {DBSCAN_EPS}) AS BIGINT) AS n_neighbours,
       count_if(d <= {DBSCAN_EPS}) >= {DBSCAN_MIN_PTS} AS is_core
FROM pairs GROUP BY id""")
def q_dbscan_core(spark, d):
    return db.neighbour_counts(P.scaled(spark, d), M, tree=MD.leaves(spark, d))


@query("dbscan_assign")
def q_dbscan_assign(spark, d):
    return MD.dbscan_labels(spark, d).select(ID, "cluster", "is_core")


@query("dbscan_summary")
def q_dbscan_summary(spark, d):
    return db.dbscan_summary(MD.dbscan_labels(spark, d))


def _db_means(spark, d):
    return MD.dbscan_labelled(spark, d).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])


@query("dbscan_means")
def q_dbscan_means(spark, d):
    return _db_means(spark, d)


@query("dbscan_means_long")
def q_dbscan_means_long(spark, d):
    return reshape.unpivot_measures(_db_means(spark, d), ["cluster"], M, "variable", "value")


@query("dbscan_projection")
def q_dbscan_projection(spark, d):
    """PC1-2 of the unstandardised (already scaled) input with DBSCAN labels."""
    x = MD.dbscan_labelled(spark, d)
    return stats.PCAFit(x, M).scores(x, (ID, "cluster"), 2)


# ---------------------------------------------------------------- PCA

def _pca(spark, d):
    return stats.PCAFit(P.trimmed(spark, d), M)


@query("pca_variance")
def q_pca_variance(spark, d):
    return _pca(spark, d).variance_table(spark)


@query("scree")
def q_scree(spark, d):
    return _pca(spark, d).variance_table(spark).where(F.col("k") <= 10)


@query("pca_loadings")
def q_pca_loadings(spark, d):
    return _pca(spark, d).loadings_table(spark)


@query("pca_scores")
def q_pca_scores(spark, d):
    x = P.trimmed(spark, d)
    return stats.PCAFit(x, M).scores(x)


@query("pca_top3")
def q_pca_top3(spark, d):
    x = MD.lloyd_labelled(spark, d)
    return stats.PCAFit(x, M).scores(x, (ID, "cluster"), 3)


@query("biplot_coords")
def q_biplot_coords(spark, d):
    x = P.trimmed(spark, d)
    pts, arrows = stats.PCAFit(x, M).biplot(x)
    return pts.select(F.lit("point").alias("kind"), F.col(ID).cast("string").alias("label"), "x", "y") \
        .unionByName(arrows.select(F.lit("loading").alias("kind"), F.col("variable").alias("label"), "x", "y"))


PCA2 = ("care_contacts", "referrals")


@query("pca_variance_2d", O.chain("trimmed") + f"""
, r AS (SELECT abs(corr({PCA2[0]}, {PCA2[1]})) AS a FROM trimmed)
SELECT 'PC1' AS component, round(sqrt(1 + a), 6) AS sdev, round((1 + a) / 2, 6) AS proportion, round((1 + a) / 2, 6) AS cumulative FROM r
UNION ALL
SELECT 'PC2', round(sqrt(1 - a), 6), round((1 - a) / 2, 6), 1.0 FROM r""")
def q_pca_variance_2d(spark, d):
    return stats.PCAFit(P.trimmed(spark, d), list(PCA2)).variance_table(spark).drop("k")


# ---------------------------------------------------------------- VIF and linear model

@query("vif")
def q_vif(spark, d):
    return stats.vif_table(P.trimmed(spark, d))


VIF3 = ("referrals", "length_care", "remote_contact_prop")


@query("vif_3", O.chain("trimmed") + f"""
, r AS (SELECT corr({VIF3[0]}, {VIF3[1]}) AS r12, corr({VIF3[0]}, {VIF3[2]}) AS r13,
               corr({VIF3[1]}, {VIF3[2]}) AS r23 FROM trimmed)
SELECT '{VIF3[0]}' AS variable, round(1 / (1 - (r12*r12 + r13*r13 - 2*r12*r13*r23) / (1 - r23*r23)), 6) AS vif FROM r
UNION ALL SELECT '{VIF3[1]}', round(1 / (1 - (r12*r12 + r23*r23 - 2*r12*r13*r23) / (1 - r13*r13)), 6) FROM r
UNION ALL SELECT '{VIF3[2]}', round(1 / (1 - (r13*r13 + r23*r23 - 2*r12*r13*r23) / (1 - r12*r12)), 6) FROM r""")
def q_vif_3(spark, d):
    rows = stats.vif(P.trimmed(spark, d), "care_contacts", list(VIF3))
    return spark.createDataFrame(rows, "variable string, vif double")


@query("vif_band")
def q_vif_band(spark, d):
    return stats.vif_table(P.trimmed(spark, d)).select("variable", "band")


@query("lm_care_contacts")
def q_lm(spark, d):
    preds = [c for c in M if c != "care_contacts"]
    rows = stats.linear_model(P.trimmed(spark, d), "care_contacts", preds)
    return spark.createDataFrame(rows, "term string, estimate double")


@query("lm_simple", O.chain("trimmed") + """
SELECT round(regr_intercept(care_contacts, referrals), 6) AS intercept,
       round(regr_slope(care_contacts, referrals), 6) AS slope FROM trimmed""")
def q_lm_simple(spark, d):
    x = P.trimmed(spark, d)
    return x.agg(F.regr_intercept("care_contacts", "referrals").alias("intercept"),
                  F.regr_slope("care_contacts", "referrals").alias("slope"))


# ---------------------------------------------------------------- column summaries

def _summary(df, cols):
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    agg = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols],
                 *[F.avg(c).alias(f"av_{c}") for c in cols], *[F.stddev_samp(c).alias(f"sd_{c}") for c in cols],
                 *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in cols],
                 F.count(F.lit(1)).alias("_n")).first()
    return q, agg


@query("summary_measures", O.chain("imputed") + """
SELECT name, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max,
       CAST(count_if(value IS NULL) AS BIGINT) AS n_missing
FROM (""" + O.unpivot_sql("imputed", "person_id") + ") GROUP BY name")
def q_summary_measures(spark, d):
    x = P.imputed(spark, d)
    q, a = _summary(x, M)
    rows = [(c, a[f"mn_{c}"], q[(c, 0.25)], q[(c, 0.5)], a[f"av_{c}"], q[(c, 0.75)], a[f"mx_{c}"], a[f"na_{c}"])
            for c in M]
    return spark.createDataFrame(rows, "name string, min double, q1 double, median double, mean double, "
                                       "q3 double, max double, n_missing bigint")


@query("skim_numeric", O.chain("reduced") + """
SELECT name, CAST(count_if(value IS NULL) AS BIGINT) AS n_missing,
       round(count(value) / CAST(count(*) AS DOUBLE), 6) AS complete_rate,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
       round(min(value), 6) AS p0, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
       round(max(value), 6) AS p100
FROM (""" + O.unpivot_sql("reduced", "person_id") + ") GROUP BY name")
def q_skim_numeric(spark, d):
    x = P.reduced(spark, d)
    q, a = _summary(x, M)
    n = a["_n"]
    rows = [(c, a[f"na_{c}"], (n - a[f"na_{c}"]) / n if n else None, a[f"av_{c}"], a[f"sd_{c}"],
             a[f"mn_{c}"], q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], a[f"mx_{c}"]) for c in M]
    return spark.createDataFrame(rows, "name string, n_missing bigint, complete_rate double, mean double, "
                                       "sd double, p0 double, p25 double, p50 double, p75 double, p100 double")


HIST_BINS = 8


@query("skim_hist", O.chain("reduced") + f"""
, u AS ({O.unpivot_sql("reduced", "person_id")}),
rg AS (SELECT name, min(value) AS lo, max(value) AS hi FROM u GROUP BY name)
SELECT u.name, CAST(CASE WHEN rg.hi = rg.lo THEN 0
                         ELSE least(floor((u.value - rg.lo) / (rg.hi - rg.lo) * {HIST_BINS}), {HIST_BINS - 1}) END AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS n
FROM u JOIN rg ON rg.name = u.name WHERE u.value IS NOT NULL GROUP BY u.name, bin""")
def q_skim_hist(spark, d):
    long = reshape.unpivot_measures(P.reduced(spark, d), [ID], M).where(F.col("value").isNotNull())
    rng = long.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per measure: bounded broadcast
    j = long.join(F.broadcast(rng), "name")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * HIST_BINS),
                F.lit(HIST_BINS - 1))).cast("int")
    return j.groupBy("name", b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("skim_character", O.chain("reduced") + """
SELECT 'org_id_provider' AS name, CAST(count_if(org_id_provider IS NULL) AS BIGINT) AS n_missing,
       min(length(org_id_provider)) AS min_len, max(length(org_id_provider)) AS max_len,
       CAST(count_if(org_id_provider = '') AS BIGINT) AS empty,
       CAST(count(DISTINCT org_id_provider) AS BIGINT) AS n_unique,
       CAST(count_if(trim(org_id_provider) = '' AND org_id_provider <> '') AS BIGINT) AS whitespace
FROM reduced""")
def q_skim_character(spark, d):
    x = P.reduced(spark, d)
    c = F.col(ORG)
    return x.agg(F.lit(ORG).alias("name"), F.count_if(c.isNull()).cast("bigint").alias("n_missing"),
                 F.min(F.length(c)).cast("bigint").alias("min_len"), F.max(F.length(c)).cast("bigint").alias("max_len"),
                 F.count_if(c == "").cast("bigint").alias("empty"),
                 F.countDistinct(c).cast("bigint").alias("n_unique"),
                 F.count_if((F.trim(c) == "") & (c != "")).cast("bigint").alias("whitespace"))


def _pair_corr_sql():
    sel = []
    for i, a in enumerate(M):
        for j, b in enumerate(M):
            if i < j:
                sel.append(f"SELECT l.cluster, '{a}' AS var_x, '{b}' AS var_y, round(corr(s.{a}, s.{b}), 6) AS r "
                           f"FROM scaled s JOIN k6_lab_final l USING (person_id) GROUP BY l.cluster")
    return SCALED + "," + KM6 + "\n" + " UNION ALL ".join(sel)


@query("pair_corr_by_cluster", _pair_corr_sql())
def q_pair_corr_by_cluster(spark, d):
    x = MD.lloyd_labelled(spark, d)
    pairs = [(a, b) for i, a in enumerate(M) for j, b in enumerate(M) if i < j]
    wide = x.groupBy("cluster").agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    exprs = [F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"{a}__{b}").alias("r"))
             for a, b in pairs]
    return wide.select("cluster", F.explode(F.array(*exprs)).alias("p")).select("cluster", "p.*")
