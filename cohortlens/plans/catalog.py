"""Registry of named queries: a Spark builder and its SQL twin.

Each query takes (spark, data_dir) and returns a DataFrame; doubles are
rounded to 6 places and counts are BIGINT so results compare across
engines.  The SQL twin (DuckDB) re-derives everything from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import round_doubles
from cohortlens.operators import clean, impute, outliers, reshape, stats
from cohortlens.plans import oracle as O
from cohortlens.plans import prepare as P
from cohortlens.schema import ID, MEASURES, ORG
from cohortlens.sources.lookups import measure_lookup
from cohortlens.sources.measures import key_measures_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

M = MEASURES


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, d: round_doubles(fn(spark, d))
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _cols6(prefix: str = "", cols=M) -> str:
    return ", ".join(f"{O.r6(prefix + c)} AS {c}" for c in cols)


# ---------------------------------------------------------------- sources

@query("key_measures_raw", O.chain("raw") + """
SELECT person_id, org_id_provider, CAST(first_contact AS VARCHAR) AS first_contact,
       CAST(last_contact AS VARCHAR) AS last_contact, CAST(care_mid_date AS VARCHAR) AS care_mid_date,
       """ + _cols6("", ["care_contacts", "referrals", "length_care", "average_daily_contacts",
                          "contact_prop_aft_midpoint"]) + """,
       team_input_count, intermittent_care_periods,
       """ + _cols6("", ["specialist_contact_prop", "remote_contact_prop"]) + """,
       avg_contact_duration, acute_admissions_2223
FROM key_measures_raw""")
def q_key_measures_raw(spark, d):
    df = P.raw(spark, d)
    return df.withColumns({c: F.col(c).cast("string") for c in ["first_contact", "last_contact", "care_mid_date"]})


# ---------------------------------------------------------------- cleaning

@query("cast_measures", O.chain("raw") + """
SELECT person_id, TRY_CAST(trim(team_input_count) AS DOUBLE) AS team_input_count,
       TRY_CAST(trim(intermittent_care_periods) AS DOUBLE) AS intermittent_care_periods,
       TRY_CAST(trim(avg_contact_duration) AS DOUBLE) AS avg_contact_duration,
       TRY_CAST(trim(acute_admissions_2223) AS DOUBLE) AS acute_admissions_2223
FROM key_measures_raw""")
def q_cast_measures(spark, d):
    df = clean.cast_measures(clean.clean_names(P.raw(spark, d)))
    return df.select(ID, "team_input_count", "intermittent_care_periods", "avg_contact_duration",
                     "acute_admissions_2223")


@query("fill_zero", O.chain("raw") + """
SELECT person_id, COALESCE(TRY_CAST(trim(intermittent_care_periods) AS DOUBLE), 0.0) AS intermittent_care_periods,
       COALESCE(TRY_CAST(trim(acute_admissions_2223) AS DOUBLE), 0.0) AS acute_admissions_2223
FROM key_measures_raw""")
def q_fill_zero(spark, d):
    df = clean.fill_zero(clean.cast_measures(P.raw(spark, d)))
    return df.select(ID, "intermittent_care_periods", "acute_admissions_2223")


@query("count_per_person", O.chain("raw") + """
SELECT person_id, CAST(count(*) AS BIGINT) AS n FROM key_measures_raw GROUP BY person_id""")
def q_count_per_person(spark, d):
    return clean.count_per_person(P.raw(spark, d)).withColumn("n", F.col("n").cast("bigint"))


@query("duplicated_ids", O.chain("raw") + """
SELECT person_id FROM key_measures_raw GROUP BY person_id HAVING count(*) > 1""")
def q_duplicated_ids(spark, d):
    return clean.duplicated_ids(P.raw(spark, d))


@query("dedup_drop_all", O.chain("reduced") + f"""
SELECT person_id, org_id_provider, {_cols6()} FROM reduced""")
def q_dedup_drop_all(spark, d):
    return P.reduced(spark, d)


@query("na_count_before", O.chain("reduced") + f"""
SELECT CAST({' + '.join(f'count_if({c} IS NULL OR isnan({c}))' for c in M)} + count_if(org_id_provider IS NULL)
       + count_if(person_id IS NULL) AS BIGINT) AS n_missing FROM reduced""")
def q_na_count_before(spark, d):
    return clean.missing_count(P.reduced(spark, d))


@query("na_count_after", O.chain("imputed") + f"""
SELECT CAST({' + '.join(f'count_if({c} IS NULL OR isnan({c}))' for c in M)} + count_if(org_id_provider IS NULL)
       + count_if(person_id IS NULL) AS BIGINT) AS n_missing FROM imputed""")
def q_na_count_after(spark, d):
    return clean.missing_count(P.imputed(spark, d))


# ---------------------------------------------------------------- imputation

@query("dist_team_by_org", O.chain("reduced") + """
SELECT org_id_provider, team_input_count AS field, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY org_id_provider) AS DOUBLE), 6) AS probability,
       max(team_input_count) OVER (PARTITION BY org_id_provider) AS team_count
FROM reduced WHERE team_input_count IS NOT NULL GROUP BY org_id_provider, team_input_count""")
def q_dist_team_by_org(spark, d):
    return impute.value_distribution(P.reduced(spark, d), "team_input_count", ORG, "team_count")


@query("dist_team_overall", O.chain("reduced") + """
SELECT team_input_count AS field, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS probability
FROM reduced WHERE team_input_count IS NOT NULL GROUP BY team_input_count""")
def q_dist_team_overall(spark, d):
    return impute.value_distribution(P.reduced(spark, d), "team_input_count")


@query("dist_duration", O.chain("reduced") + """
SELECT avg_contact_duration AS field, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS probability
FROM reduced WHERE avg_contact_duration IS NOT NULL GROUP BY avg_contact_duration""")
def q_dist_duration(spark, d):
    return impute.value_distribution(P.reduced(spark, d), "avg_contact_duration")


@query("impute_team", O.chain("imputed") + """
SELECT person_id, org_id_provider, team_input_count FROM imputed""")
def q_impute_team(spark, d):
    df = impute.impute_draw(P.reduced(spark, d), "team_input_count", "team", group=ORG)
    return df.select(ID, ORG, "team_input_count")


@query("impute_duration", O.chain("imputed") + """
SELECT person_id, avg_contact_duration FROM imputed""")
def q_impute_duration(spark, d):
    df = impute.impute_draw(P.reduced(spark, d), "avg_contact_duration", "duration")
    return df.select(ID, "avg_contact_duration")


@query("imputed_table", O.chain("imputed") + f"""
SELECT person_id, org_id_provider, {_cols6()} FROM imputed""")
def q_imputed_table(spark, d):
    return P.imputed(spark, d)


# ---------------------------------------------------------------- outliers

@query("quantile99", O.chain("imputed") + "SELECT name, round(quantile_cont(value, 0.99), 6) AS quantile_99 FROM ("
       + O.unpivot_sql("imputed", "person_id") + ") GROUP BY name")
def q_quantile99(spark, d):
    return outliers.quantile_table(P.imputed(spark, d))


@query("outlier_ids", O.chain("trimmed") + """
SELECT person_id FROM imputed EXCEPT SELECT person_id FROM trimmed""")
def q_outlier_ids(spark, d):
    return outliers.outlier_ids(P.imputed(spark, d).drop(ORG))


@query("outliers_removed", O.chain("trimmed") + f"""
SELECT person_id, {_cols6()} FROM trimmed""")
def q_outliers_removed(spark, d):
    return P.trimmed(spark, d)


@query("outliers_removed_antijoin", O.chain("trimmed") + f"""
SELECT person_id, {_cols6()} FROM trimmed""")
def q_outliers_removed_antijoin(spark, d):
    return outliers.remove_outliers_antijoin(P.imputed(spark, d).drop(ORG))


# ---------------------------------------------------------------- standardise

@query("zscore_wide", O.chain("scaled") + f"""
SELECT person_id, {_cols6()} FROM scaled""")
def q_zscore_wide(spark, d):
    return P.scaled(spark, d)


@query("unpivot_measures", O.chain("trimmed") + "SELECT person_id, name, round(value, 6) AS value FROM ("
       + O.unpivot_sql("trimmed", "person_id") + ")")
def q_unpivot_measures(spark, d):
    return reshape.unpivot_measures(P.trimmed(spark, d), [ID], M)


@query("scaled_long", O.chain("trimmed") + """
SELECT person_id, name, round((value - avg(value) OVER (PARTITION BY name)) / stddev_samp(value) OVER (PARTITION BY name), 6)
       AS value_scale FROM (""" + O.unpivot_sql("trimmed", "person_id") + ")")
def q_scaled_long(spark, d):
    long = reshape.unpivot_measures(P.trimmed(spark, d), [ID], M)
    return stats.group_zscore(long).select(ID, "name", "value_scale")


@query("scaled_wide", O.chain("scaled") + f"""
SELECT person_id, {_cols6()} FROM scaled""")
def q_scaled_wide(spark, d):
    long = stats.group_zscore(reshape.unpivot_measures(P.trimmed(spark, d), [ID], M))
    return reshape.pivot_measures(long, ID, M, value="value_scale")


@query("join_labels", O.chain("trimmed") + f"""
SELECT u.person_id, u.name, round(u.value, 6) AS value, l.variable_clean
FROM ({O.unpivot_sql("trimmed", "person_id")}) u LEFT JOIN (SELECT * FROM {O.LOOKUP_LABELS}) l ON u.name = l.variable""")
def q_join_labels(spark, d):
    long = reshape.unpivot_measures(P.trimmed(spark, d), [ID], M)
    return reshape.join_labels(long, measure_lookup(spark))


@query("total_ss", O.chain("trimmed") + "SELECT round((count(*) - 1) * ("
       + " + ".join(f"var_samp({c})" for c in M) + "), 6) AS total_ss FROM trimmed")
def q_total_ss(spark, d):
    return stats.total_ss(P.trimmed(spark, d))


# ---------------------------------------------------------------- correlation

def _corr_sql(where: str = "") -> str:
    pairs = []
    for i, a in enumerate(M):
        for j, b in enumerate(M):
            r = "max(1.0)" if i == j else f"corr({a}, {b})"
            pairs.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {i + 1} AS i, {j + 1} AS j, "
                         f"round(CAST({r} AS DOUBLE), 6) AS r FROM trimmed")
    return O.chain("trimmed") + "SELECT * FROM (" + " UNION ALL ".join(pairs) + ") " + where


@query("corr_matrix", _corr_sql())
def q_corr_matrix(spark, d):
    return stats.corr_long(P.trimmed(spark, d))


@query("corr_upper", _corr_sql("WHERE i <= j"))
def q_corr_upper(spark, d):
    return stats.corr_triangle(stats.corr_long(P.trimmed(spark, d)), upper=True)


@query("corr_lower", _corr_sql("WHERE i >= j"))
def q_corr_lower(spark, d):
    return stats.corr_triangle(stats.corr_long(P.trimmed(spark, d)), upper=False)


# the clustering-half queries register themselves into the same tables
from cohortlens.plans import catalog_models  # noqa: E402,F401
from cohortlens.plans import catalog_stats  # noqa: E402,F401
from cohortlens.plans import catalog_mixture  # noqa: E402,F401
from cohortlens.plans import catalog_io  # noqa: E402,F401
from cohortlens.plans import catalog_more  # noqa: E402,F401
from cohortlens.plans import catalog_scale  # noqa: E402,F401
from cohortlens.plans import catalog_pca  # noqa: E402,F401
from cohortlens.plans import catalog_kmeans  # noqa: E402,F401
