"""Registered queries of the clustering half: K-means, profiles, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortlens.operators import evaluate as ev
from cohortlens.operators import kmeans as km
from cohortlens.operators import kmeans_many as kk
from cohortlens.operators import reshape, stats
from cohortlens.operators.sampling import sample_key_sql
from cohortlens.plans import models as MD
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.plans.catalog import query
from cohortlens.schema import ELBOW_MAX_K, ELBOW_SEED, ID, KMEANS_KS, MEASURES
from cohortlens.sources.lookups import measure_lookup

M = MEASURES


def dist2_sql(a: str, b: str, cols=M, bcols=None) -> str:
    bcols = bcols or cols
    return " + ".join(f"({a}.{x} - {b}.{y}) * ({a}.{x} - {b}.{y})" for x, y in zip(cols, bcols))


def lloyd_sql(table: str, k: int, seed: int, steps: int = MD.LLOYD_STEPS, cols=M, key: str = ID) -> str:
    """CTE blocks lab_final(key, cluster) and cen_final after `steps` Lloyd updates."""
    cl = ", ".join(cols)
    parts = [f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sk, {key}) AS BIGINT) AS cluster, {cl}
  FROM (SELECT *, {sample_key_sql(key, seed)} AS sk FROM {table})
  QUALIFY row_number() OVER (ORDER BY sk, {key}) <= {k})"""]
    for t in range(1, steps + 2):
        parts.append(f"""a{t} AS (
  SELECT {key}, cluster FROM (
    SELECT s.{key}, c.cluster,
           row_number() OVER (PARTITION BY s.{key} ORDER BY {dist2_sql('s', 'c', cols)}, c.cluster) AS rn
    FROM {table} s CROSS JOIN c{t - 1} c) WHERE rn = 1)""")
        if t <= steps:
            sel = ", ".join(f"COALESCE(n.{x}, p.{x}) AS {x}" for x in cols)
            avg = ", ".join(f"avg(s.{x}) AS {x}" for x in cols)
            parts.append(f"""c{t} AS (
  SELECT p.cluster, {sel} FROM c{t - 1} p LEFT JOIN (
    SELECT a.cluster, {avg} FROM a{t} a JOIN {table} s ON s.{key} = a.{key} GROUP BY a.cluster) n
  ON n.cluster = p.cluster)""")
    parts.append(f"lab_final AS (SELECT * FROM a{steps + 1})")
    parts.append(f"cen_final AS (SELECT * FROM c{steps})")
    return ",\n".join(parts)


def _lloyd_block(k, seed, prefix):
    body = lloyd_sql("scaled", k, seed)
    # rename CTEs so two runs can live in one WITH
    import re
    body = re.sub(r"\b(c\d+|a\d+|lab_final|cen_final)\b", lambda m: f"{prefix}_{m.group(1)}", body)
    return body


KM6 = _lloyd_block(6, 123, "k6")
KM5 = _lloyd_block(5, 1234, "k5")
SCALED = O.chain("scaled")

SAMPLE = f"""samp_ids AS (
  SELECT person_id FROM (SELECT person_id, {sample_key_sql('person_id', 123)} AS sk FROM scaled)
  QUALIFY row_number() OVER (ORDER BY sk, person_id) <= floor(0.25 * count(*) OVER ()))"""


def _samp(lab: str) -> str:
    return f"""samp AS (
  SELECT s.*, l.cluster FROM scaled s JOIN samp_ids i ON i.person_id = s.person_id
  JOIN {lab} l ON l.person_id = s.person_id)"""


def _sil_sql(samp="samp", cols=M, key=ID, label="cluster") -> str:
    return f"""pairs AS (
  SELECT a.{key} AS id, a.{label} AS cl, b.{label} AS ref, sqrt({dist2_sql('a', 'b', cols)}) AS d
  FROM {samp} a CROSS JOIN {samp} b),
per AS (SELECT id, cl, ref, sum(d) AS sd, count(*) AS n FROM pairs GROUP BY id, cl, ref),
w AS (
  SELECT id, cl, max(CASE WHEN ref = cl THEN n END) AS n_own, max(CASE WHEN ref = cl THEN sd END) AS s_own,
         min(CASE WHEN ref <> cl THEN sd / n END) AS b
  FROM per GROUP BY id, cl),
sil AS (
  SELECT id, cl, CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
                      ELSE (b - s_own / (n_own - 1)) / greatest(s_own / (n_own - 1), b) END AS s FROM w)"""


def _db_sql(samp="samp", cols=M, label="cluster") -> str:
    avg = ", ".join(f"avg({x}) AS {x}" for x in cols)
    return f"""cen AS (SELECT {label} AS cluster, {avg} FROM {samp} GROUP BY {label}),
spr AS (SELECT s.{label} AS cluster, sqrt(avg({dist2_sql('s', 'c', cols)})) AS sp
        FROM {samp} s JOIN cen c ON c.cluster = s.{label} GROUP BY s.{label}),
rr AS (SELECT a.cluster, max((sa.sp + sb.sp) / sqrt({dist2_sql('a', 'b', cols)})) AS r
       FROM cen a JOIN cen b ON a.cluster <> b.cluster
       JOIN spr sa ON sa.cluster = a.cluster JOIN spr sb ON sb.cluster = b.cluster GROUP BY a.cluster)"""


def _wcss_sql(samp="samp", cols=M, label="cluster") -> str:
    avg = ", ".join(f"avg({x}) AS {x}" for x in cols)
    return f"""cen2 AS (SELECT {label} AS cluster, {avg} FROM {samp} GROUP BY {label}),
wss AS (SELECT s.{label} AS cluster, count(*) AS size, sum({dist2_sql('s', 'c', cols)}) AS withinss
        FROM {samp} s JOIN cen2 c ON c.cluster = s.{label} GROUP BY s.{label})"""


def _labelled_sample(spark, d, k=6, seed=123):
    return MD.eval_sample(spark, d).join(MD.lloyd_labels(spark, d, k, seed), ID)


# ---------------------------------------------------------------- K-means (fixed steps)

@query("kmeans_lloyd3", SCALED + "," + KM6 + "\nSELECT person_id, cluster FROM k6_lab_final")
def q_kmeans_lloyd3(spark, d):
    return MD.lloyd_labels(spark, d)


@query("kmeans_centres_lloyd3", SCALED + "," + KM6 + "\nSELECT cluster, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in M) + " FROM k6_cen_final")
def q_kmeans_centres_lloyd3(spark, d):
    return km.centres_table(spark, M, MD.lloyd_centres(spark, d))


@query("withinss_by_cluster", SCALED + "," + KM6 + ",\nlab AS (SELECT s.*, l.cluster FROM scaled s JOIN k6_lab_final l USING (person_id)),\n"
       + _wcss_sql("lab") + "\nSELECT cluster, CAST(size AS BIGINT) AS size, round(withinss, 6) AS withinss FROM wss")
def q_withinss_by_cluster(spark, d):
    x = MD.lloyd_labelled(spark, d)
    return ev.withinss(x, M).withColumn("size", F.col("size").cast("bigint"))


def _profile_sql():
    return (SCALED + "," + KM6 + ",\nmeans AS (SELECT l.cluster, " + ", ".join(f"avg(s.{c}) AS {c}" for c in M)
            + " FROM scaled s JOIN k6_lab_final l USING (person_id) GROUP BY l.cluster),\n"
            "prof AS (SELECT 'Profile ' || CAST(row_number() OVER (ORDER BY cluster) AS VARCHAR) AS profile, "
            + ", ".join(f"round({c}, 3) AS {c}" for c in M) + " FROM means)\n")


def _profile_means(spark, d):
    x = MD.lloyd_labelled(spark, d)
    means = x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])
    # a few rows (one per cluster): numbering them in one window is bounded.
    rank = F.row_number().over(Window.orderBy("cluster"))
    return means.select(F.concat(F.lit("Profile "), rank.cast("string")).alias("profile"),
                        *[F.round(c, 3).alias(c) for c in M])


@query("profile_means_kmeans", _profile_sql() + "SELECT * FROM prof")
def q_profile_means_kmeans(spark, d):
    return _profile_means(spark, d)


@query("profile_long_kmeans", _profile_sql() + "SELECT p.profile, u.name, u.value, l.variable_clean FROM ("
       + " UNION ALL ".join(f"SELECT profile, '{c}' AS name, {c} AS value FROM prof" for c in M)
       + f") u JOIN prof p ON p.profile = u.profile LEFT JOIN (SELECT * FROM {O.LOOKUP_LABELS}) l ON l.variable = u.name")
def q_profile_long_kmeans(spark, d):
    long = reshape.unpivot_measures(_profile_means(spark, d), ["profile"], M)
    return reshape.join_labels(long, measure_lookup(spark))


def _means_sql(source="scaled"):
    return (",\nmeans AS (SELECT l.cluster, " + ", ".join(f"avg(s.{c}) AS {c}" for c in M)
            + f" FROM {source} s JOIN k6_lab_final l USING (person_id) GROUP BY l.cluster)\n")


@query("cluster_means", SCALED + "," + KM6 + _means_sql() + "SELECT cluster, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in M) + " FROM means")
def q_cluster_means(spark, d):
    x = MD.lloyd_labelled(spark, d)
    return x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])


@query("cluster_means_long", SCALED + "," + KM6 + _means_sql() + "SELECT cluster, variable, round(value, 6) AS value FROM ("
       + " UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, {c} AS value FROM means" for c in M) + ")")
def q_cluster_means_long(spark, d):
    x = MD.lloyd_labelled(spark, d)
    means = x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])
    return reshape.unpivot_measures(means, ["cluster"], M, "variable", "value")


@query("cluster_means_scaled", SCALED + "," + KM6 + _means_sql() + """SELECT cluster, variable,
  round((value - avg(value) OVER (PARTITION BY variable)) / stddev_samp(value) OVER (PARTITION BY variable), 6) AS value_scaled
FROM (""" + " UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, {c} AS value FROM means" for c in M) + ")")
def q_cluster_means_scaled(spark, d):
    x = MD.lloyd_labelled(spark, d)
    means = x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])
    long = reshape.unpivot_measures(means, ["cluster"], M, "variable", "value")
    return stats.group_zscore(long, "variable", "value", "value_scaled").select("cluster", "variable", "value_scaled")


@query("cluster_means_original", O.chain("scaled") + "," + KM6 + _means_sql("trimmed") + "SELECT cluster, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in M) + " FROM means")
def q_cluster_means_original(spark, d):
    x = P.trimmed(spark, d).join(MD.lloyd_labels(spark, d), ID)
    return x.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in M])


# ---------------------------------------------------------------- K-means fits (invariant-checked)

@query("wss_by_k")
def q_wss_by_k(spark, d):
    fit = km.sweep(P.scaled(spark, d), M, KMEANS_KS, nstart=1, max_iter=10, seed=123)
    rows = [(k, f"clusters_{k}", float(fit.best(k).cost)) for k in KMEANS_KS]
    fits = spark.createDataFrame(rows, "k int, id string, tot_withinss double")
    # numbered and ordered as the table of fits is drawn: a row per fit
    return (fits.withColumn("rn", F.row_number().over(Window.orderBy("k"))).orderBy("rn").select("id", "tot_withinss", "rn"))


@query("elbow_curve")
def q_elbow_curve(spark, d):
    x = P.scaled(spark, d)
    fit = kk.fit_many(x, M, {k: (25, 100) for k in range(2, ELBOW_MAX_K + 1)}, seed=ELBOW_SEED)
    k1 = stats.total_ss(x).first()["total_ss"]
    rows = [(1, float(k1))] + [(k, float(fit.best(k).cost)) for k in range(2, ELBOW_MAX_K + 1)]
    return spark.createDataFrame(rows, "k int, wss double")


@query("kmeans_assign")
def q_kmeans_assign(spark, d):
    return MD.kmeans_labels(spark, d)


# ---------------------------------------------------------------- evaluation on given labels

@query("subsample", SCALED + ",\n" + SAMPLE + "\nSELECT person_id FROM samp_ids")
def q_subsample(spark, d):
    return MD.eval_sample(spark, d).select(ID)


EVAL_HEAD = SCALED + ",\n" + SAMPLE + ",\n" + KM6 + ",\n" + _samp("k6_lab_final") + ",\n"


@query("silhouette_exact", EVAL_HEAD + _sil_sql() + "\nSELECT round(avg(s), 6) AS silhouette_score FROM sil")
def q_silhouette_exact(spark, d):
    return ev.silhouette(_labelled_sample(spark, d), M)


@query("silhouette_by_cluster", EVAL_HEAD + _sil_sql()
       + "\nSELECT cl AS cluster, CAST(count(*) AS BIGINT) AS size, round(avg(s), 6) AS avg_width FROM sil GROUP BY cl")
def q_silhouette_by_cluster(spark, d):
    return ev.silhouette_by_cluster(_labelled_sample(spark, d), M).withColumn("size", F.col("size").cast("bigint"))


@query("davies_bouldin", EVAL_HEAD + _db_sql() + "\nSELECT round(avg(r), 6) AS db_index FROM rr")
def q_davies_bouldin(spark, d):
    return ev.davies_bouldin(_labelled_sample(spark, d), M)


@query("wcss_labels", EVAL_HEAD + _wcss_sql() + "\nSELECT round(sum(withinss), 6) AS wcss FROM wss")
def q_wcss_labels(spark, d):
    return ev.wcss_labels(_labelled_sample(spark, d), M)


TWO_RUNS = SCALED + ",\n" + KM6 + ",\n" + KM5 + ",\n"


@query("contingency", TWO_RUNS + """ct AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n
  FROM k6_lab_final a JOIN k5_lab_final b USING (person_id) GROUP BY a.cluster, b.cluster)
SELECT a, b, CAST(n AS BIGINT) AS n FROM ct""")
def q_contingency(spark, d):
    a = MD.lloyd_labels(spark, d, 6, 123).withColumnRenamed("cluster", "a")
    b = MD.lloyd_labels(spark, d, 5, 1234).withColumnRenamed("cluster", "b")
    return ev.contingency(a, b).withColumn("n", F.col("n").cast("bigint"))


ARI_SQL = """ct AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n
  FROM {A} a JOIN {B} b ON a.{k} = b.{k} GROUP BY a.cluster, b.cluster),
s AS (SELECT sum(n * (n - 1) / 2.0) AS sij, sum(n) AS n FROM ct),
ra AS (SELECT sum(m * (m - 1) / 2.0) AS sa FROM (SELECT a, sum(n) AS m FROM ct GROUP BY a)),
rb AS (SELECT sum(m * (m - 1) / 2.0) AS sb FROM (SELECT b, sum(n) AS m FROM ct GROUP BY b)),
e AS (SELECT sij, sa * sb / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM s, ra, rb)
SELECT round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) AS ari FROM e"""


@query("adjusted_rand", TWO_RUNS + ARI_SQL.format(A="k6_lab_final", B="k5_lab_final", k="person_id"))
def q_adjusted_rand(spark, d):
    a = MD.lloyd_labels(spark, d, 6, 123).withColumnRenamed("cluster", "a")
    b = MD.lloyd_labels(spark, d, 5, 1234).withColumnRenamed("cluster", "b")
    return ev.adjusted_rand(a, b)


def _eval_rows_sql(prefix: str, name: str, order: int) -> str:
    return f"""ev_{prefix} AS (
  SELECT '{name}' AS model, {order} AS model_order,
         (SELECT avg(s) FROM sil_{prefix}) AS silhouette_score,
         (SELECT avg(r) FROM rr_{prefix}) AS db_index,
         (SELECT sum(withinss) FROM wss_{prefix}) AS wcss)"""


def _eval_sql():
    import re
    blocks = []
    for prefix in ("k6", "k5"):
        samp = f"""samp_{prefix} AS (
  SELECT s.*, l.cluster FROM scaled s JOIN samp_ids i ON i.person_id = s.person_id
  JOIN {prefix}_lab_final l ON l.person_id = s.person_id)"""
        body = _sil_sql(f"samp_{prefix}") + ",\n" + _db_sql(f"samp_{prefix}") + ",\n" + _wcss_sql(f"samp_{prefix}")
        body = re.sub(r"\b(pairs|per|w|sil|cen|spr|rr|cen2|wss)\b", lambda m: f"{m.group(1)}_{prefix}", body)
        blocks.append(samp + ",\n" + body)
    return (SCALED + ",\n" + SAMPLE + ",\n" + KM6 + ",\n" + KM5 + ",\n" + ",\n".join(blocks) + ",\n"
            + _eval_rows_sql("k6", "K-means 6", 1) + ",\n" + _eval_rows_sql("k5", "K-means 5", 2)
            + ",\nmetrics AS (SELECT * FROM ev_k6 UNION ALL SELECT * FROM ev_k5)")


def _metrics(spark, d):
    runs = [("K-means 6", 6, 123), ("K-means 5", 5, 1234)]
    labels = [f"k{k}" for _, k, _ in runs]
    x = MD.eval_sample(spark, d)
    for name, (_, k, seed) in zip(labels, runs):
        x = x.join(MD.lloyd_labels(spark, d, k, seed).withColumnRenamed("cluster", name), ID)
    x = P.stage(spark, d, "eval_given", lambda: x)
    sils = ev.silhouettes(x, M, labels)
    rows = [(name, order, sil, ev.davies_bouldin_value(x, M, label), ev.wcss_labels(x, M, label).first()[0])
            for order, ((name, _, _), label, sil) in enumerate(zip(runs, labels, sils), start=1)]
    return spark.createDataFrame(rows, "model string, model_order int, silhouette_score double, "
                                       "db_index double, wcss double")


@query("evaluate_given", _eval_sql() + "\nSELECT model, model_order, round(silhouette_score, 6) AS silhouette_score, "
       "round(db_index, 6) AS db_index, round(wcss, 6) AS wcss FROM metrics")
def q_evaluate_given(spark, d):
    return _metrics(spark, d)


SCORED_SQL = """,
ext AS (SELECT max(silhouette_score) AS smax, min(db_index) AS dmin, min(wcss) AS wmin FROM metrics),
scored AS (SELECT model, model_order, silhouette_score, db_index, wcss,
                  silhouette_score / smax AS normalized_silhouette, dmin / db_index AS normalized_db_index,
                  wmin / wcss AS normalized_wcss,
                  silhouette_score / smax + dmin / db_index + wmin / wcss AS combined_score
           FROM metrics CROSS JOIN ext)"""


@query("model_scores", _eval_sql() + SCORED_SQL + "\nSELECT model, model_order, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ["silhouette_score", "db_index", "wcss", "normalized_silhouette",
                                      "normalized_db_index", "normalized_wcss", "combined_score"]) + " FROM scored")
def q_model_scores(spark, d):
    return ev.score_models(_metrics(spark, d))


@query("optimum_model", _eval_sql() + SCORED_SQL
       + "\nSELECT model, round(combined_score, 6) AS combined_score FROM scored ORDER BY combined_score DESC, model_order LIMIT 1")
def q_optimum_model(spark, d):
    return ev.optimum_model(ev.score_models(_metrics(spark, d)))


# ---------------------------------------------------------------- embeddings (known classes)

EMB = [f"e{i}" for i in range(64)]    # the twins spell out the columns; the queries take them from the data
EMB_SRC = "emb AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(len(EMB))) + " FROM embeddings)"


@query("silhouette_embeddings", "WITH " + EMB_SRC + ",\n" + _sil_sql("emb", EMB, "vec_id", "label")
       + "\nSELECT round(avg(s), 6) AS silhouette_score FROM sil")
def q_silhouette_embeddings(spark, d):
    e = MD.embeddings(spark, d)
    return ev.silhouette(e, MD.emb_cols(e), "label", "vec_id")


@query("davies_bouldin_embeddings", "WITH " + EMB_SRC + ",\n" + _db_sql("emb", EMB, "label")
       + "\nSELECT round(avg(r), 6) AS db_index FROM rr")
def q_davies_bouldin_embeddings(spark, d):
    e = MD.embeddings(spark, d)
    return ev.davies_bouldin(e, MD.emb_cols(e), "label")


@query("wcss_embeddings", "WITH " + EMB_SRC + ",\n" + _wcss_sql("emb", EMB, "label")
       + "\nSELECT round(sum(withinss), 6) AS wcss FROM wss")
def q_wcss_embeddings(spark, d):
    e = MD.embeddings(spark, d)
    return ev.wcss_labels(e, MD.emb_cols(e), "label")


def _emb_lloyd():
    import re
    body = lloyd_sql("emb", 10, 123, cols=EMB, key="vec_id")
    return re.sub(r"\b(c\d+|a\d+|lab_final|cen_final)\b", lambda m: f"em_{m.group(1)}", body)


@query("adjusted_rand_embeddings", "WITH " + EMB_SRC + ",\n" + _emb_lloyd() + ",\nlab AS (SELECT vec_id, label AS cluster FROM emb),\n"
       + ARI_SQL.format(A="lab", B="em_lab_final", k="vec_id"))
def q_adjusted_rand_embeddings(spark, d):
    e = MD.embeddings(spark, d)
    cols = MD.emb_cols(e)
    start = km.start_rows(e, cols, [123], 10, key="vec_id")[123]
    c = km.fixed_steps(e, cols, start, MD.LLOYD_STEPS)
    fitted = km.assign(e, cols, c, "b").select("vec_id", "b")
    return ev.adjusted_rand(e.select("vec_id", F.col("label").alias("a")), fitted, key="vec_id")
