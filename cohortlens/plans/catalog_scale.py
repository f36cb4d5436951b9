"""Registered queries of the operators for large tables: leaves, fast silhouettes, many K-means fits, models saved."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import density_scan as ds
from cohortlens.operators import evaluate as ev
from cohortlens.operators import kmeans as km
from cohortlens.operators import kmeans_many as kk
from cohortlens.operators import mixture as mx
from cohortlens.operators import pairplot as pp
from cohortlens.operators import silhouette_fast as sf
from cohortlens.operators import stats
from cohortlens.operators.sampling import sample_key, sample_key_sql
from cohortlens.plans import models as MD
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import query
from cohortlens.plans.catalog_models import KM6, SCALED, _sil_sql, dist2_sql
from cohortlens.plans.catalog_more import DB
from cohortlens.schema import DBSCAN_EPS, DBSCAN_MIN_PTS, EVAL_SEED, ID, KMEANS_SETTINGS, MEASURES
from cohortlens.sources import bundles, io

M = MEASURES
QUERY_ROWS = 2000       # rows asked by the sampled operators: a sample is what they are for

LAB = SCALED + "," + KM6 + ",\nlab AS (SELECT s.*, l.cluster FROM scaled s JOIN k6_lab_final l USING (person_id))"

# ---------------------------------------------------------------- silhouettes

_SQUARED = LAB + ",\n" + _sil_sql("lab").replace("sqrt(", "(")


@query("silhouette_squared", _SQUARED + "\nSELECT round(avg(s), 6) AS silhouette_score FROM sil")
def q_silhouette_squared(spark, d):
    """Mean width over all rows with squared distances, by cluster moments."""
    return sf.squared_rows(MD.lloyd_labelled(spark, d), M).agg(F.avg("s").alias("silhouette_score"))


@query("silhouette_squared_by_cluster", _SQUARED
       + "\nSELECT cl AS cluster, CAST(count(*) AS BIGINT) AS size, round(avg(s), 6) AS avg_width FROM sil GROUP BY cl")
def q_silhouette_squared_by_cluster(spark, d):
    return (sf.squared_rows(MD.lloyd_labelled(spark, d), M).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("size"), F.avg("s").alias("avg_width")))


def _asked(df):
    """The sampled rows: the smallest keys of the evaluation seed."""
    return df.orderBy(sample_key(ID, EVAL_SEED), ID).limit(QUERY_ROWS)


def _asked_sql(table: str) -> str:
    return (f"asked AS (SELECT * FROM {table} QUALIFY row_number() OVER "
            f"(ORDER BY {sample_key_sql('person_id', EVAL_SEED)}, person_id) <= {QUERY_ROWS})")


@query("silhouette_sampled", LAB + ",\n" + _asked_sql("lab") + ",\n"
       + _sil_sql("lab").replace("FROM lab a CROSS JOIN lab b", "FROM asked a CROSS JOIN lab b")
       + "\nSELECT id AS person_id, cl AS cluster, round(s, 6) AS s FROM sil")
def q_silhouette_sampled(spark, d):
    """Exact widths of a bounded sample against all rows."""
    x = MD.lloyd_labelled(spark, d)
    return sf.sampled_rows(x, _asked(x), M).select(ID, "cluster", "s")


@query("knn_sampled", SCALED + ",\n" + _asked_sql("scaled") + f"""
SELECT id AS person_id, round(d, 6) AS knn_dist FROM (
  SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM (
    SELECT a.person_id AS id, sqrt({dist2_sql('a', 'b')}) AS d FROM asked a JOIN scaled b ON a.person_id <> b.person_id))
WHERE rn = {DBSCAN_MIN_PTS}""")
def q_knn_sampled(spark, d):
    x = P.scaled(spark, d)
    return sf.sampled_knn(x, _asked(x), M, DBSCAN_MIN_PTS)


# ---------------------------------------------------------------- leaves

@query("knn_visits")
def q_knn_visits(spark, d):
    """Leaves beyond its own that each row asked for its k-th nearest neighbour."""
    return MD.knn(spark, d).select(ID, F.col("visits").cast("bigint").alias("visits"))


@query("dbscan_work")
def q_dbscan_work(spark, d):
    """Row copies and distances of each step of the fit, beside what all pairs would cost."""
    fit = MD.dbscan_fit(spark, d)
    n = P.scaled(spark, d).count()
    return spark.createDataFrame([(i, step, copies, taken, n) for i, (step, copies, taken) in enumerate(fit.work)],
                                 "i int, step string, copies bigint, distances bigint, n_rows bigint")


_OUT = DB.rstrip().rstrip(",") + f""",
fitted AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}" for c in M)} FROM trimmed),
outs AS (SELECT i.person_id, {", ".join(f"(i.{c} - f.a_{c}) / f.s_{c} AS {c}" for c in M)}
         FROM imputed i CROSS JOIN fitted f WHERE i.person_id NOT IN (SELECT person_id FROM trimmed)),
cores AS (SELECT s.*, dbl.cluster FROM scaled s JOIN dbl USING (person_id) WHERE dbl.is_core)
SELECT o.person_id, CAST(coalesce(min(c.cluster), 0) AS BIGINT) AS cluster
FROM outs o LEFT JOIN cores c ON sqrt({dist2_sql('o', 'c')}) <= {DBSCAN_EPS} GROUP BY o.person_id"""


@query("dbscan_outliers", _OUT)
def q_dbscan_outliers(spark, d):
    """Persons dropped as outliers, labelled by the fit that has not seen them."""
    moments = stats.column_moments(P.trimmed(spark, d), M)
    left = P.imputed(spark, d).join(P.trimmed(spark, d).select(ID), ID, "left_anti")
    z = left.select(ID, *[((F.col(c) - F.lit(moments[c][0])) / F.lit(moments[c][1])).alias(c) for c in M])
    return ds.assign(MD.dbscan_fit(spark, d), z)


# ---------------------------------------------------------------- K-means

_TRANSFER = LAB + f""",
cs AS (SELECT cluster, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in M)} FROM lab GROUP BY cluster),
own AS (SELECT l.person_id, l.cluster, CASE WHEN c.n > 1 THEN ({dist2_sql('l', 'c')}) * (c.n / (c.n - 1.0)) ELSE 0 END AS cost
        FROM lab l JOIN cs c ON c.cluster = l.cluster),
oth AS (SELECT l.person_id, c.cluster AS target, ({dist2_sql('l', 'c')}) * (c.n / (c.n + 1.0)) AS cost
        FROM lab l JOIN cs c ON c.cluster <> l.cluster),
low AS (SELECT * FROM oth QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY cost, target) = 1)
SELECT person_id, own.cluster, low.target, round(own.cost - low.cost, 6) AS gain
FROM own JOIN low USING (person_id) WHERE own.cost - low.cost > 1e-9 * (1 + own.cost)"""


@query("kmeans_transfer_round", _TRANSFER)
def q_kmeans_transfer_round(spark, d):
    """The moves of one round of transfers from the given labels: row, target, what the total falls by."""
    x = MD.lloyd_labelled(spark, d)
    moves = kk.best_moves(x, M, kk.moments(x, M, F.col("cluster")))
    return moves.where("target is not null").select(ID, "cluster", "target", "gain")


@query("kmeans_hartigan")
def q_kmeans_hartigan(spark, d):
    """Labels after Lloyd's fit of k = 6 and transfers until no single move lowers the total."""
    return MD.hartigan_rows(spark, d).select(ID, "cluster")


@query("kmeans_stated_centres")
def q_kmeans_stated_centres(spark, d):
    """Every k by the study's own starts and limits: centres, sizes, within sums, whether the fit has settled."""
    fit = MD.stated_sweep(spark, d)
    rows = [(k, c + 1, int(r.sizes[c]), float(r.withinss[c]), float(r.cost), bool(r.converged), int(r.iterations), *map(float, r.centres[c]))
            for k in KMEANS_SETTINGS for r in (fit.best(k),) for c in range(k)]
    return spark.createDataFrame(rows, "k int, cluster bigint, size bigint, withinss double, tot_withinss double, converged boolean, "
                                       "iterations int, " + ", ".join(f"{c} double" for c in M))


@query("kmeans_stated_labels")
def q_kmeans_stated_labels(spark, d):
    fit = MD.stated_sweep(spark, d)
    return km.assign_all(P.scaled(spark, d), M, {f"clusters_{k}": fit.best(k).centres for k in KMEANS_SETTINGS})


# ---------------------------------------------------------------- pair matrix

_U = LAB + ",\nu AS (" + " UNION ALL ".join(f"SELECT cluster, '{c}' AS name, {c} AS v FROM lab" for c in M) + ")"

DENSITY_OF_U = """,
st AS (SELECT cluster, name, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx,
              quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM u GROUP BY cluster, name),
bw AS (SELECT cluster, name, n, 0.9 * CASE WHEN least(coalesce(sd, 0), iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                                  WHEN sd > 0 THEN sd WHEN mn <> 0 THEN abs(mn) ELSE 1.0 END * pow(n, -0.2) AS bw, mn, mx FROM st),
gp AS (SELECT cluster, name, n, bw, mn AS lo, CASE WHEN mx > mn THEN (mx - mn) / 511 ELSE 1.0 END AS step FROM bw),
pos AS (SELECT u.cluster, u.name, (u.v - g.lo) / g.step AS p FROM u JOIN gp g ON g.name = u.name AND g.cluster = u.cluster),
ix AS (SELECT cluster, name, CAST(least(floor(p), 510) AS INTEGER) AS i, p - least(floor(p), 510) AS f FROM pos),
bins AS (SELECT cluster, name, i, sum(w) AS w FROM (
           SELECT cluster, name, i, 1 - f AS w FROM ix UNION ALL SELECT cluster, name, i + 1, f FROM ix) GROUP BY cluster, name, i),
grid AS (SELECT g.cluster, g.name, t.i, g.lo + g.step * t.i AS x FROM gp g CROSS JOIN range(512) t(i))
SELECT gr.cluster, gr.name, CAST(gr.i AS INTEGER) AS i, round(gr.x, 6) AS x,
       round(sum(b.w * exp(-0.5 * pow((gr.x - (g.lo + g.step * b.i)) / g.bw, 2)) / sqrt(2 * pi())) / (g.n * g.bw), 6) AS density
FROM grid gr JOIN gp g ON g.name = gr.name AND g.cluster = gr.cluster JOIN bins b ON b.name = gr.name AND b.cluster = gr.cluster
GROUP BY gr.cluster, gr.name, gr.i, gr.x, g.n, g.bw"""


@query("pair_density_by_cluster", _U + DENSITY_OF_U)
def q_pair_density_by_cluster(spark, d):
    return pp.density_by_group(MD.lloyd_labelled(spark, d), "cluster", M)


HIST_OF_U = f""",
rg AS (SELECT name, min(v) AS lo, max(v) AS hi FROM u GROUP BY name)
SELECT u.cluster, u.name, CAST(CASE WHEN rg.hi = rg.lo THEN 0 ELSE least(floor(round((u.v - rg.lo) / (rg.hi - rg.lo) * {pp.BINS}, 9)), {pp.BINS - 1}) END AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS n FROM u JOIN rg ON rg.name = u.name GROUP BY u.cluster, u.name, bin"""


@query("pair_hist_by_cluster", _U + HIST_OF_U)
def q_pair_hist_by_cluster(spark, d):
    return pp.histogram_by_group(MD.lloyd_labelled(spark, d), "cluster", M)


def _components(spark, d):
    """(person_id, cluster, PC1..PC11): the labels of the table that the scores come from, no join."""
    x = MD.lloyd_labelled(spark, d)
    return stats.PCAFit(x, M).scores(x, (ID, "cluster"))


PCS = [f"PC{i + 1}" for i in range(len(M))]


@query("pc_pair_density")
def q_pc_pair_density(spark, d):
    """The pair matrix on the principal components, as the study draws it: its curves."""
    return pp.density_by_group(_components(spark, d), "cluster", PCS)


@query("pc_pair_hist")
def q_pc_pair_hist(spark, d):
    return pp.histogram_by_group(_components(spark, d), "cluster", PCS)


# ---------------------------------------------------------------- mixtures, saved models

@query("lpa_parameters")
def q_lpa_parameters(spark, d):
    """Weight, mean and variance of each measure in each profile of the chosen mixture."""
    fit = MD.chosen_mixture(spark, d)
    rows = [(k + 1, float(fit.pi[k]), c, float(fit.mu[k][j]), float(fit.sigma[k][j, j])) for k in range(fit.g) for j, c in enumerate(M)]
    return spark.createDataFrame(rows, "cluster bigint, weight double, variable string, mean double, variance double")


@query("lpa_responsibilities")
def q_lpa_responsibilities(spark, d):
    """(person_id, cluster, probability) for every person and profile."""
    return mx.responsibilities(P.scaled(spark, d), M, MD.chosen_mixture(spark, d))


@query("saved_models", SCALED + "," + KM6 + f""",
final AS (SELECT s.person_id, c.cluster, row_number() OVER (PARTITION BY s.person_id ORDER BY {dist2_sql('s', 'c')}, c.cluster) AS rn
          FROM scaled s CROSS JOIN k6_cen_final c)
SELECT person_id, cluster FROM final WHERE rn = 1""")
def q_saved_models(spark, d):
    """Models stored with their tables, loaded back, and the rows labelled by what was loaded."""
    x = MD.lloyd_labelled(spark, d)
    path = bundles.save(spark, io.results_root(spark) + "/models", {"labels": x.select(ID, "cluster"), "wss": ev.withinss(x, M)},
                        {"kmeans": bundles.KMeansModel(M, MD.lloyd_centres(spark, d)), "pca": bundles.PCAModel.of(stats.PCAFit(x, M))})
    return bundles.load(spark, path).models["kmeans"].label(P.scaled(spark, d)).select(ID, "cluster")
