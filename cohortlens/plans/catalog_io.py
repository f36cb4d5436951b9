"""Registered queries: sources and sinks, fitted-model evaluation, densities, shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import evaluate as ev
from cohortlens.operators import kmeans as km
from cohortlens.operators.density import density_curves
from cohortlens.plans import models as MD
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import _cols6, query
from cohortlens.plans.catalog_models import KM6, SCALED
from cohortlens.schema import ID, MEASURES
from cohortlens.sources import io

M = MEASURES
RAW_COLS = [f.name for f in io.RAW_SCHEMA.fields]


# ---------------------------------------------------------------- sources and sinks

@query("csv_roundtrip", O.chain("raw") + """
SELECT person_id, org_id_provider, CAST(first_contact AS VARCHAR) AS first_contact,
       CAST(last_contact AS VARCHAR) AS last_contact, CAST(care_mid_date AS VARCHAR) AS care_mid_date,
       """ + _cols6("", ["care_contacts", "referrals", "length_care", "average_daily_contacts",
                          "contact_prop_aft_midpoint"]) + """,
       team_input_count, intermittent_care_periods,
       """ + _cols6("", ["specialist_contact_prop", "remote_contact_prop"]) + """,
       avg_contact_duration, acute_admissions_2223
FROM key_measures_raw""")
def q_csv_roundtrip(spark, d):
    """Write the raw extract as CSV, scan it back with the declared schema."""
    path = io.write_csv(P.raw(spark, d).select(*RAW_COLS), io.results_root(spark) + "/key_measures_csv")
    back = io.scan_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("string") for c in ["first_contact", "last_contact", "care_mid_date"]})


@query("table_roundtrip", O.chain("scaled") + f"SELECT person_id, {_cols6()} FROM scaled")
def q_table_roundtrip(spark, d):
    """Save the scaled table as a catalog table in its own schema, read it by name."""
    root = io.results_root(spark)
    before = spark.catalog.currentDatabase()
    io.use_schema(spark, "cohortlens_results")
    try:
        io.write_table(P.scaled(spark, d), "cohortlens_results.key_measures_scaled_wide", root + "/scaled_wide")
        return spark.table("spark_catalog.cohortlens_results.key_measures_scaled_wide")
    finally:
        spark.catalog.setCurrentDatabase(before)


@query("saved_results", SCALED + "," + KM6 + "\nSELECT person_id, cluster FROM k6_lab_final")
def q_saved_results(spark, d):
    """Save a result bundle (labels + centres) and load the labels back."""
    path = io.save_bundle({"kmeans_labels": MD.lloyd_labels(spark, d),
                           "kmeans_centres": km.centres_table(spark, M, MD.lloyd_centres(spark, d))},
                          io.results_root(spark) + "/bundle")
    return io.load_bundle(spark, path, ["kmeans_labels"])["kmeans_labels"]


# ---------------------------------------------------------------- shaping

@query("head_n", O.chain("scaled") + f"SELECT person_id, {_cols6()} FROM scaled ORDER BY person_id LIMIT 10000")
def q_head_n(spark, d):
    """First 10,000 persons by id (a top-k; the limit is the operator)."""
    return P.scaled(spark, d).orderBy(ID).limit(10000)


@query("feature_matrix", O.chain("scaled") + "SELECT person_id, [" + ", ".join(f"round({c}, 6)" for c in M)
       + "] AS features FROM scaled")
def q_feature_matrix(spark, d):
    x = P.scaled(spark, d)
    return x.select(ID, F.array(*[F.round(c, 6) for c in M]).alias("features"))


@query("category_codes", SCALED + "," + KM6 + """
SELECT person_id, CAST(dense_rank() OVER (ORDER BY 'Cluster ' || CAST(cluster AS VARCHAR)) AS BIGINT) AS code
FROM k6_lab_final""")
def q_category_codes(spark, d):
    """Factor codes: levels sorted as text, code = position of the level."""
    lab = MD.lloyd_labels(spark, d).withColumn("level", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    levels = lab.select("level").distinct()
    # one row per level: a bounded single-partition ranking, joined back by AQE broadcast
    codes = levels.withColumn("code", F.dense_rank().over(Window.orderBy("level")).cast("bigint"))
    return lab.join(codes, "level").select(ID, "code")


# ---------------------------------------------------------------- density curves

def _density_sql(stage: str) -> str:
    u = O.unpivot_sql(stage, "person_id", value="v")
    return O.chain("scaled") + f""",
u AS (SELECT name, v FROM ({u}) WHERE v IS NOT NULL),
st AS (SELECT name, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx,
              quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM u GROUP BY name),
bw AS (SELECT name, n, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                                  WHEN sd > 0 THEN sd WHEN mn <> 0 THEN abs(mn) ELSE 1.0 END * pow(n, -0.2) AS bw, mn, mx FROM st),
gp AS (SELECT name, n, bw, mn AS lo, CASE WHEN mx > mn THEN (mx - mn) / 511 ELSE 1.0 END AS step FROM bw),
pos AS (SELECT u.name, (u.v - g.lo) / g.step AS p FROM u JOIN gp g ON g.name = u.name),
ix AS (SELECT name, CAST(least(floor(p), 510) AS INTEGER) AS i, p - least(floor(p), 510) AS f FROM pos),
bins AS (SELECT name, i, sum(w) AS w FROM (
           SELECT name, i, 1 - f AS w FROM ix UNION ALL SELECT name, i + 1, f FROM ix) GROUP BY name, i),
grid AS (SELECT g.name, t.i, g.lo + g.step * t.i AS x FROM gp g CROSS JOIN range(512) t(i))
SELECT gr.name, CAST(gr.i AS INTEGER) AS i, round(gr.x, 6) AS x,
       round(sum(b.w * exp(-0.5 * pow((gr.x - (g.lo + g.step * b.i)) / g.bw, 2)) / sqrt(2 * pi())) / (g.n * g.bw), 6) AS density
FROM grid gr JOIN gp g ON g.name = gr.name JOIN bins b ON b.name = gr.name
GROUP BY gr.name, gr.i, gr.x, g.n, g.bw"""


@query("density_imputed", _density_sql("imputed"))
def q_density_imputed(spark, d):
    return density_curves(P.imputed(spark, d), M)


@query("density_trimmed", _density_sql("trimmed"))
def q_density_trimmed(spark, d):
    return density_curves(P.trimmed(spark, d), M)


@query("density_scaled", _density_sql("scaled"))
def q_density_scaled(spark, d):
    return density_curves(P.scaled(spark, d), M)


# ---------------------------------------------------------------- evaluation of the fitted models

def _fitted_labels(spark, d):
    return [("K-means", 1, MD.kmeans_labels(spark, d), None),
            ("LPA", 2, MD.lpa_labels(spark, d).select(ID, "cluster"), None),
            ("DBSCAN", 3, MD.dbscan_labels(spark, d).select(ID, "cluster"), 0)]


def _fitted_metrics(spark, d, refit: bool = False):
    models = _fitted_labels(spark, d)
    names = [f"model{order}" for _, order, _, _ in models]
    x = MD.eval_sample(spark, d)
    for col, (_, _, labels, _) in zip(names, models):
        x = x.join(labels.withColumnRenamed("cluster", col), ID)
    x = P.stage(spark, d, "eval_fitted", lambda: x)
    rows = []
    for col, sil, (name, order, _, noise) in zip(names, ev.silhouettes(x, M, names), models):
        db = ev.davies_bouldin_value(x, M, col, drop_label=noise)
        if refit:
            k = x.select(col).distinct().count()
            w = ev.wcss_refit(x, M, k)
        else:
            w = ev.wcss_labels(x, M, col).first()[0]
        rows.append((name, order, sil, db, w))
    return spark.createDataFrame(rows, "model string, model_order int, silhouette_score double, "
                                       "db_index double, wcss double")


@query("evaluate_models")
def q_evaluate_models(spark, d):
    return _fitted_metrics(spark, d)


@query("wcss_refit")
def q_wcss_refit(spark, d):
    return _fitted_metrics(spark, d, refit=True).select("model", "wcss")


@query("model_scores_fitted")
def q_model_scores_fitted(spark, d):
    return ev.score_models(_fitted_metrics(spark, d))


@query("model_scores_refit")
def q_model_scores_refit(spark, d):
    """The combined score with the sum of squares of a fresh K-means, as the study takes it."""
    return ev.score_models(_fitted_metrics(spark, d, refit=True))


@query("optimum_model_fitted")
def q_optimum_model_fitted(spark, d):
    return ev.optimum_model(ev.score_models(_fitted_metrics(spark, d)))


@query("adjusted_rand_kmeans_lpa")
def q_adjusted_rand_kmeans_lpa(spark, d):
    a = MD.kmeans_labels(spark, d).withColumnRenamed("cluster", "a")
    b = MD.lpa_labels(spark, d).select(ID, F.col("cluster").alias("b"))
    return ev.adjusted_rand(a, b)


# ---------------------------------------------------------------- cluster plot data (K6) and boxes (D11)

def _projection(spark, d):
    from cohortlens.operators import stats
    x = MD.kmeans_labelled(spark, d)
    return stats.PCAFit(x, M).scores(x, (ID, "cluster"), 2).withColumnsRenamed({"PC1": "x", "PC2": "y"})


@query("cluster_projection")
def q_cluster_projection(spark, d):
    return _projection(spark, d)


@query("cluster_hull")
def q_cluster_hull(spark, d):
    from cohortlens.operators.hull import convex_hulls
    return convex_hulls(_projection(spark, d))


BOX_P = [0.0, 0.25, 0.5, 0.75, 1.0]
BOX_N = ["min", "q1", "median", "q3", "max"]


@query("pair_box_by_cluster", SCALED + "," + KM6 + ",\nu AS (" + " UNION ALL ".join(
    f"SELECT l.cluster, '{c}' AS name, s.{c} AS v FROM scaled s JOIN k6_lab_final l USING (person_id)" for c in M)
    + ")\nSELECT cluster, name, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for p, n in zip(BOX_P, BOX_N))
    + " FROM u GROUP BY cluster, name")
def q_pair_box_by_cluster(spark, d):
    from cohortlens.operators.quantile import grouped_quantiles
    x = MD.lloyd_labelled(spark, d)
    q = grouped_quantiles(x, "cluster", M, BOX_P)
    groups = sorted({g for g, _, _ in q})
    rows = [(g, c, *[q[(g, c, p)] for p in BOX_P]) for g in groups for c in M]
    return spark.createDataFrame(rows, "cluster bigint, name string, " + ", ".join(f"{n} double" for n in BOX_N))
