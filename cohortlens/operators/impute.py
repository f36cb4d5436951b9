"""Value distributions and weighted-draw imputation.

A missing value gets an independent draw, with replacement, from the observed
distribution of its column (optionally from its own organisation's
distribution, falling back to the overall one when the organisation has no
observed value).  Draws are inverse-CDF look-ups: each row has a uniform
``u`` from md5(person_id | salt), a rank ``r = floor(u * total)``, and takes
the value whose cumulative-count interval ``[lo, hi)`` holds ``r``.

The look-up is a range join made equi-join friendly: the rank space of every
distribution is cut into ``RANK_BUCKETS`` buckets, each value interval is
exploded to the buckets it covers, and rows join on (scope, group, bucket)
plus ``lo <= r < hi``.  The distribution side is an aggregate (distinct
values); AQE broadcasts it when small, otherwise both sides shuffle on the
bucketed key, which spreads even a dominant organisation evenly because
``u`` is uniform.  Only rows with a missing value take part; the others are
united with the filled ones as they are, so no key collects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import draw_rank, uniform01
from cohortlens.operators.prefix import running_total
from cohortlens.schema import ID, ORG

RANK_BUCKETS = 1024


def value_distribution(df: DataFrame, value: str, group: str | None = None,
                       group_max: str | None = None) -> DataFrame:
    """Observed distribution: ([group], field, n, probability[, group_max]).

    NULL values are dropped; probability is n over the total of the group
    (or of the whole table when ``group`` is None).
    """
    keys = [group] if group else []
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).alias("field"))
              .agg(F.count(F.lit(1)).alias("n")))
    if group:
        tot = counts.groupBy(group).agg(F.sum("n").alias("_total"), F.max("field").alias("_max"))
        out = counts.join(tot, group)
    else:
        tot = counts.agg(F.sum("n").alias("_total"), F.max("field").alias("_max"))
        total = tot.first()["_total"] or 0
        out = counts.withColumn("_total", F.lit(total)).withColumn("_max", F.lit(None))
    cols = keys + ["field", F.col("n").cast("bigint").alias("n"),
                   (F.col("n") / F.col("_total").cast("double")).alias("probability")]
    if group_max:
        cols.append(F.col("_max").alias(group_max))
    return out.select(*cols)


def _cumulative(counts: DataFrame) -> DataFrame:
    """(scope, grp, field, lo, hi, total) with lo/hi cumulative counts by field.

    A distributed running total (no window holding a whole distribution);
    group totals come from an aggregate joined back on the group key.
    """
    cum = running_total(counts, ["scope", "grp"], ["field"], "n", out="hi")
    tot = counts.groupBy("scope", "grp").agg(F.sum("n").alias("total"))
    return cum.join(tot, ["scope", "grp"]).withColumn("lo", F.col("hi") - F.col("n"))


def _bucket(r, total):
    return F.floor(r.cast("double") * RANK_BUCKETS / total.cast("double")).cast("bigint")


def impute_draw(df: DataFrame, value: str, salt: str, group: str | None = None,
                key: str = ID) -> DataFrame:
    """Fill NULLs in ``value`` by weighted draws; other columns are kept."""
    observed = df.where(F.col(value).isNotNull())
    all_counts = observed.groupBy(F.col(value).alias("field")).agg(F.count(F.lit(1)).alias("n"))
    counts = all_counts.select(F.lit("all").alias("scope"), F.lit("").alias("grp"), "field", "n")
    overall_total = all_counts.agg(F.sum("n")).first()[0]
    if overall_total is None:  # nothing observed: nothing to draw from
        return df

    if group:
        # rows without an organisation draw from the overall distribution
        org_counts = (observed.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("field"))
                      .agg(F.count(F.lit(1)).alias("n")))
        counts = counts.unionByName(org_counts.select(F.lit("org").alias("scope"), F.col("g").alias("grp"),
                                                      "field", "n"))
        org_tot = org_counts.groupBy(F.col("g").alias("_g")).agg(F.sum("n").alias("_gtotal"))
        base = df.join(org_tot, df[group] == org_tot["_g"], "left").drop("_g")
        has_org = F.col("_gtotal").isNotNull()
        scope = F.when(has_org, F.lit("org")).otherwise(F.lit("all"))
        grp = F.when(has_org, F.col(group)).otherwise(F.lit(""))
        total = F.coalesce(F.col("_gtotal"), F.lit(overall_total))
    else:
        base = df.withColumn("_gtotal", F.lit(None).cast("bigint"))
        scope, grp, total = F.lit("all"), F.lit(""), F.lit(overall_total)

    cum = _cumulative(counts)
    # only rows with a missing value are joined; the others pass by
    rank = draw_rank(uniform01(key, salt), F.col("_total"))
    left = (base.where(F.col(value).isNull())
            .withColumns({"_scope": scope, "_grp": grp, "_total": total.cast("bigint")})
            .withColumn("_r", rank).withColumn("_b", _bucket(F.col("_r"), F.col("_total"))))

    right = (cum.withColumn("_b", F.explode(F.sequence(_bucket(F.col("lo"), F.col("total")),
                                                      _bucket(F.col("hi") - 1, F.col("total")))))
             .select(F.col("scope").alias("_rs"), F.col("grp").alias("_rg"), F.col("_b").alias("_rb"),
                     F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("field").alias("_drawn")))

    cond = ((left["_scope"] == right["_rs"]) & (left["_grp"] == right["_rg"])
            & (left["_b"] == right["_rb"]) & (left["_r"] >= right["_lo"]) & (left["_r"] < right["_hi"]))
    drawn = left.join(right, cond, "left").withColumn(value, F.col("_drawn")).select(*df.columns)
    return observed.select(*df.columns).unionByName(drawn)


def impute_measures(reduced: DataFrame) -> DataFrame:
    """Both imputations of the study: team input by organisation, duration overall."""
    out = impute_draw(reduced, "team_input_count", "team", group=ORG)
    return impute_draw(out, "avg_contact_duration", "duration")
