"""Registered queries: label sets of every k, sorted curves, read-backs; and more SQL twins.

The twins of iterative results are unrolled or recursive: DBSCAN components by
a recursive closure from local minima, the inverse correlation matrix by ten
sweeps, K-means by ten explicit Lloyd updates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import clean, reshape, stats
from cohortlens.operators import kmeans as km
from cohortlens.operators.prefix import running_total
from cohortlens.plans import models as MD
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import SQL, _cols6, _corr_sql, query
from cohortlens.plans.catalog_models import KMEANS_KS, SCALED, _means_sql, _profile_means, _profile_sql, dist2_sql, lloyd_sql
from cohortlens.plans.catalog_models import KM6
from cohortlens.plans.catalog_stats import PAIRS, _db_means
from cohortlens.schema import DBSCAN_EPS, DBSCAN_MIN_PTS, ID, MEASURES
from cohortlens.sources import io
from cohortlens.sources.lookups import measure_lookup

M = MEASURES

# ---------------------------------------------------------------- DBSCAN

DB = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
near AS MATERIALIZED (SELECT id, other FROM pairs WHERE d <= {DBSCAN_EPS}),
core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= {DBSCAN_MIN_PTS}),
link AS MATERIALIZED (SELECT n.id, n.other FROM near n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.other),
reach(id, low) AS (
  SELECT id, id FROM link GROUP BY id HAVING min(other) = id
  UNION SELECT l.other, r.low FROM reach r JOIN link l ON l.id = r.id),
comp AS (SELECT id, min(low) AS comp FROM reach GROUP BY id),
num AS (SELECT comp, row_number() OVER (ORDER BY comp) AS cluster FROM (SELECT DISTINCT comp FROM comp)),
edge AS (SELECT n.id, min(c.comp) AS comp FROM near n JOIN comp c ON c.id = n.other
         WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id),
dbl AS MATERIALIZED (
  SELECT s.person_id, CAST(coalesce(num.cluster, 0) AS BIGINT) AS cluster, c.id IS NOT NULL AS is_core
  FROM scaled s LEFT JOIN comp c ON c.id = s.person_id LEFT JOIN edge e ON e.id = s.person_id
  LEFT JOIN num ON num.comp = coalesce(c.comp, e.comp)),
dmeans AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in M)} FROM scaled JOIN dbl USING (person_id) GROUP BY cluster)
"""
_DLONG = " UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, {c} AS value FROM dmeans" for c in M)

SQL["dbscan_assign"] = DB + "SELECT person_id, cluster, is_core FROM dbl"
SQL["dbscan_summary"] = DB + ("SELECT cluster, count_if(NOT is_core)::BIGINT AS border, count_if(is_core)::BIGINT AS seed, "
                              "count(*)::BIGINT AS total FROM dbl GROUP BY cluster")
SQL["dbscan_means"] = DB + "SELECT cluster, " + ", ".join(f"round({c}, 6) AS {c}" for c in M) + " FROM dmeans"
SQL["dbscan_means_long"] = DB + f"SELECT cluster, variable, round(value, 6) AS value FROM ({_DLONG})"


@query("dbscan_heatmap", DB + f"""SELECT CASE WHEN cluster = 0 THEN 'Noise' ELSE 'Cluster ' || cluster END AS cluster, variable,
  round(coalesce((value - avg(value) OVER (PARTITION BY variable))
                 / nullif(stddev_samp(value) OVER (PARTITION BY variable), 0), NULL), 6) AS value_scaled FROM ({_DLONG})""")
def q_dbscan_heatmap(spark, d):
    """Heat map data of the cluster means, noise as one group."""
    long = reshape.unpivot_measures(_db_means(spark, d), ["cluster"], M, "variable", "value")
    z = stats.group_zscore(long, "variable", "value", "value_scaled")
    name = F.when(F.col("cluster") == 0, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return z.select(name.alias("cluster"), "variable", "value_scaled")


@query("knn_curve", PAIRS + f"""
SELECT CAST(row_number() OVER (ORDER BY d, id) AS BIGINT) AS rank, id AS person_id, round(d, 6) AS knn_dist FROM (
  SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM pairs WHERE id <> other)
WHERE rn = {DBSCAN_MIN_PTS}""")
def q_knn_curve(spark, d):
    """The sorted k-nearest-neighbour curve: ranks by a distributed running count."""
    knn = MD.knn(spark, d).select(ID, "knn_dist").withColumn("one", F.lit(1))
    return (running_total(knn, [], ["knn_dist", ID], "one", out="rank")
            .select(F.col("rank").cast("bigint").alias("rank"), ID, "knn_dist"))


# ---------------------------------------------------------------- K-means, every k

STEPS = 10      # the default iteration limit of the study's per-k fits


def _lloyd10(k: int) -> str:
    body = re.sub(r"\b(c\d+|a\d+|lab_final|cen_final)\b", lambda m: f"k{k}_{m.group(1)}", lloyd_sql("scaled", k, 123, STEPS))
    return re.sub(r"(k\d+_[ac]\d+) AS \(", r"\1 AS MATERIALIZED (", body)


LLOYD_ALL = SCALED + ",\n" + ",\n".join(_lloyd10(k) for k in KMEANS_KS)


def _wss10(k: int) -> str:
    return (f"SELECT {k} AS k, a.cluster, count(*) AS size, sum({dist2_sql('s', 'c')}) AS withinss FROM k{k}_lab_final a "
            f"JOIN scaled s USING (person_id) JOIN k{k}_cen_final c ON c.cluster = a.cluster GROUP BY a.cluster")


SQL["wss_by_k"] = LLOYD_ALL + "\nSELECT 'clusters_' || k AS id, round(sum(withinss), 6) AS tot_withinss, " \
    f"CAST(k - {min(KMEANS_KS) - 1} AS INTEGER) AS rn FROM (" + " UNION ALL ".join(_wss10(k) for k in KMEANS_KS) + ") GROUP BY k"


def _sweep(spark, d):
    return km.sweep(P.scaled(spark, d), M, KMEANS_KS, nstart=1, max_iter=STEPS, seed=123)


@query("kmeans_labels_all_k", LLOYD_ALL + "\nSELECT s.person_id, " + ", ".join(f"k{k}_lab_final.cluster AS clusters_{k}" for k in KMEANS_KS)
       + " FROM scaled s " + " ".join(f"JOIN k{k}_lab_final ON k{k}_lab_final.person_id = s.person_id" for k in KMEANS_KS))
def q_kmeans_labels_all_k(spark, d):
    """Labels of the fits for every k, side by side: no join, all from the same rows."""
    fit = _sweep(spark, d)
    return km.assign_all(P.scaled(spark, d), M, {f"clusters_{k}": fit.best(k).centres for k in KMEANS_KS})


@query("kmeans_sizes_all_k", LLOYD_ALL + "\nSELECT 'clusters_' || k AS id, cluster, CAST(size AS BIGINT) AS size, round(withinss, 6) AS withinss FROM ("
       + " UNION ALL ".join(_wss10(k) for k in KMEANS_KS) + ")")
def q_kmeans_sizes_all_k(spark, d):
    """Sizes and within-cluster sums of every fit: a union of one small frame per fit."""
    fit = _sweep(spark, d)
    frames = [spark.createDataFrame([(f"clusters_{k}", c + 1, int(n), float(w)) for c, (n, w) in
                                     enumerate(zip(fit.best(k).sizes, fit.best(k).withinss)) if n],
                                    "id string, cluster bigint, size bigint, withinss double") for k in KMEANS_KS]
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------- linear algebra twins

def _sweeps(n: int, pivots: int) -> str:
    """CTEs s0 -> s{pivots}: sweep the symmetric matrix m_i_j on its first ``pivots`` rows."""
    out = []
    for k in range(pivots):
        cells = []
        for i in range(n):
            for j in range(n):
                a = f"m_{i}_{j}"
                if i == k and j == k:
                    e = f"1 / m_{k}_{k}"
                elif i == k:
                    e = f"{a} / m_{k}_{k}"
                elif j == k:
                    e = f"-{a} / m_{k}_{k}"
                else:
                    e = f"{a} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k}"
                cells.append(f"{e} AS {a}")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM s{k})")
    return ",\n".join(out)


PRED = [c for c in M if c != "care_contacts"]
_P = len(PRED)
_VIF = (O.chain("trimmed") + ",\ns0 AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS m_{i}_{j}" for i, a in enumerate(PRED) for j, b in enumerate(PRED)) + " FROM trimmed),\n" + _sweeps(_P, _P)
    + ",\nv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, m_{i}_{i} AS vif FROM s{_P}" for i, c in enumerate(PRED)) + "),\n"
    "b AS (SELECT variable, vif, CASE WHEN vif <= 1.000001 THEN 'none' WHEN vif <= 5 THEN 'moderate' ELSE 'problematic' END AS band FROM v)\n")
SQL["vif"] = _VIF + "SELECT variable, round(vif, 6) AS vif, band FROM b"
SQL["vif_band"] = _VIF + "SELECT variable, band FROM b"

_XY = [*PRED, "care_contacts"]
SQL["lm_care_contacts"] = (O.chain("trimmed") + ",\ns0 AS (SELECT " + ", ".join(
    f"covar_samp({a}, {b}) AS m_{i}_{j}" for i, a in enumerate(_XY) for j, b in enumerate(_XY)) + " FROM trimmed),\n" + _sweeps(_P + 1, _P)
    + ",\nav AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in M) + " FROM trimmed)\n"
    + f"SELECT '(Intercept)' AS term, round(care_contacts - ({' + '.join(f'm_{i}_{_P} * {c}' for i, c in enumerate(PRED))}), 6) AS estimate "
    + f"FROM s{_P}, av UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', round(m_{i}_{_P}, 6) FROM s{_P}" for i, c in enumerate(PRED)))


@query("corr_labelled", _corr_sql().replace("SELECT * FROM (", "SELECT a.variable_clean AS x, b.variable_clean AS y, r FROM (", 1)
       + f" c LEFT JOIN (SELECT * FROM {O.LOOKUP_LABELS}) a ON a.variable = c.var_x"
         f" LEFT JOIN (SELECT * FROM {O.LOOKUP_LABELS}) b ON b.variable = c.var_y")
def q_corr_labelled(spark, d):
    """The correlation table with display names on both sides."""
    c = stats.corr_long(P.trimmed(spark, d))
    for side, col in (("x", "var_x"), ("y", "var_y")):
        names = measure_lookup(spark).select(F.col("variable").alias(col), F.col("variable_clean").alias(side))
        c = c.join(names, col, "left")
    return c.select("x", "y", "r")


# ---------------------------------------------------------------- cleaning and read-backs

@query("dedup_row_number", O.chain("raw") + """
, n AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY care_contacts) AS rn FROM key_measures_raw)
SELECT person_id, CAST(count(*) AS BIGINT) AS n_rows FROM n
WHERE person_id NOT IN (SELECT person_id FROM n WHERE rn > 1) GROUP BY person_id""")
def q_dedup_row_number(spark, d):
    """Persons without a second row, by row number instead of a count."""
    raw = P.raw(spark, d)
    n = raw.withColumn("rn", F.row_number().over(Window.partitionBy(ID).orderBy("care_contacts")))
    again = n.where("rn > 1").select(ID).distinct()
    return raw.join(again, ID, "left_anti").groupBy(ID).agg(F.count(F.lit(1)).alias("n_rows"))


@query("clean_names_raw", O.chain("raw") + f"SELECT person_id, {_cols6('', ['care_contacts', 'referrals', 'length_care'])} FROM key_measures_raw")
def q_clean_names(spark, d):
    """Columns named for people ("Care Contacts") brought to snake case."""
    raw = P.raw(spark, d).select(ID, "care_contacts", "referrals", "length_care")
    titled = raw.toDF(*[c.replace("_", " ").title() for c in raw.columns])
    return clean.clean_names(titled)


@query("view_readback", O.chain("scaled") + f"SELECT person_id, {_cols6()} FROM scaled WHERE care_contacts > 0")
def q_view_readback(spark, d):
    """Register the scaled table as a view and query it by name."""
    P.scaled(spark, d).createOrReplaceTempView("key_measures_scaled_view")
    return spark.sql(f"SELECT {ID}, {', '.join(M)} FROM key_measures_scaled_view WHERE care_contacts > 0")


@query("saved_profiles", _profile_sql() + "SELECT * FROM prof")
def q_saved_profiles(spark, d):
    """Save the profile table and the scaled means in one bundle, load the profiles back."""
    means = MD.lloyd_labelled(spark, d).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])
    path = io.save_bundle({"profiles": _profile_means(spark, d), "cluster_means": means}, io.results_root(spark) + "/profiles")
    return io.load_bundle(spark, path, ["profiles"])["profiles"]
