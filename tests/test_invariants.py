"""Invariants of the iterative / matrix operators on the smallest driver tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluate, kmeans, mixture, stats
from cohortlens.plans import prepare as P
from cohortlens.schema import ID, MEASURES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def scaled(spark):
    return P.scaled(spark, SMALL)


def test_scaled_is_standardised(scaled):
    row = scaled.agg(*[F.avg(c) for c in MEASURES], *[F.stddev_samp(c) for c in MEASURES]).first()
    for i in range(len(MEASURES)):
        assert abs(row[i]) < 1e-9
        assert row[len(MEASURES) + i] == pytest.approx(1.0)


def test_pca_invariants(spark, scaled):
    fit = stats.PCAFit(scaled, MEASURES)
    assert fit.eigenvalues.sum() == pytest.approx(len(MEASURES))
    sc = fit.scores(scaled).toPandas()
    var = sc[[f"PC{k + 1}" for k in range(3)]].var(ddof=1).to_numpy()
    assert np.allclose(var, fit.eigenvalues[:3], rtol=1e-6)
    assert abs(np.corrcoef(sc["PC1"], sc["PC2"])[0, 1]) < 1e-6


def test_vif_at_least_one(spark, scaled):
    for _, v in stats.vif(scaled, "care_contacts", [c for c in MEASURES if c != "care_contacts"]):
        assert v >= 1 - 1e-9


def test_kmeans_cost_and_elbow(spark, scaled):
    fit = kmeans.sweep(scaled, MEASURES, [2, 4, 6], nstart=3, max_iter=50, seed=5)
    costs = [fit.best(k).cost for k in (2, 4, 6)]
    assert costs[0] >= costs[1] >= costs[2]
    best = fit.best(4)
    lab = kmeans.assign(scaled, MEASURES, best.centres)
    wss = evaluate.wcss_labels(lab, MEASURES).first()[0]
    assert wss == pytest.approx(best.cost, rel=1e-9)


def test_mixture_loglik_monotone_and_g1_closed_form(spark, scaled):
    fits = mixture.fit_grid(scaled, MEASURES, [1, 3], ["EII", "VVI", "EEE", "VVV", "EEV", "EVE", "VVE"])
    for (g, m), f in fits.items():
        if f.failed:
            continue
        h = np.array(f.history)
        assert np.all(np.diff(h) >= -1e-6 * (1 + abs(h[-1])))
    x = scaled.toPandas()[MEASURES].to_numpy()
    n, d = x.shape
    v = x.var(axis=0)
    ll = -n * d / 2 * math.log(2 * math.pi * v.mean()) - n * d / 2
    assert fits[(1, "EII")].bic(d) == pytest.approx(2 * ll - (d + 1) * math.log(n))


def test_responsibilities_sum_to_one(spark, scaled):
    fits = mixture.fit_grid(scaled, MEASURES, [3], ["EII", "VVI"])
    fit = next(f for f in fits.values() if not f.failed)
    lab = mixture.classify(scaled, MEASURES, fit).toPandas()
    assert ((lab["uncertainty"] >= 0) & (lab["uncertainty"] <= 1)).all()
    assert set(lab["cluster"]) <= {1, 2, 3}


def test_silhouette_in_range(spark, scaled):
    lab = kmeans.assign(scaled, MEASURES, kmeans.sweep(scaled, MEASURES, [3], max_iter=20).best(3).centres)
    s = evaluate.silhouette(lab, MEASURES).first()[0]
    assert -1 <= s <= 1


def test_exact_sample_size(spark, scaled):
    from cohortlens.operators.sampling import exact_sample
    n = scaled.count()
    assert exact_sample(scaled, 0.25, 123).count() == math.floor(0.25 * n)


def test_exact_quantile_two_pass_matches_percentile(spark):
    from cohortlens.operators import quantile
    df = spark.range(5000).select((F.col("id") % 97).cast("double").alias("x"),
                                  (F.col("id") * 1.37 % 11).alias("y"))
    got = quantile.exact_quantiles(df, ["x", "y"], [0.01, 0.5, 0.99], accuracy=200)
    want = df.agg(*[F.percentile(c, p) for c in ["x", "y"] for p in [0.01, 0.5, 0.99]]).first()
    keys = [(c, p) for c in ["x", "y"] for p in [0.01, 0.5, 0.99]]
    for i, k in enumerate(keys):
        assert got[k] == pytest.approx(want[i], abs=1e-12)


def test_one_partial_row_per_task_and_component(spark):
    import numpy as np
    from cohortlens.operators import kmeans
    df = spark.range(0, 100_000, 1, 4).selectExpr("cast(id % 17 as double) as x", "cast(id % 5 as double) as y")
    centres = {0: np.array([[0.0, 0.0], [8.0, 2.0], [16.0, 4.0]]), 1: np.array([[3.0, 1.0], [9.0, 3.0]])}
    assert kmeans._partials(df, ["x", "y"], centres).count() == 4 * 5      # several Arrow batches a task


def test_dbscan_ids_beyond_double_precision(spark):
    from cohortlens.operators import dbscan
    for base in (0, 2 ** 53 + 1, 2 ** 62 + 3):
        pts = [(base + i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 3, 4, 5.5, 50])]
        df = spark.createDataFrame(pts, "person_id bigint, a double, b double")
        got = {r["person_id"] - base: (r["cluster"], r["is_core"])
               for r in dbscan.dbscan(df, ["a", "b"], eps=1.8, min_pts=3).collect()}
        assert got == {0: (1, False), 1: (1, True), 2: (1, True), 3: (1, True), 4: (1, True), 5: (1, False), 6: (0, False)}


def test_density_grid_is_the_data_range(spark):
    from cohortlens.operators.density import density_curves
    df = spark.range(500).selectExpr("cast(id * id % 91 as double) as a", "7.0D as b")
    rows = {(r["name"], r["i"]): r["x"] for r in density_curves(df, ["a", "b"]).collect()}
    lo, hi = df.agg(F.min("a"), F.max("a")).first()
    assert rows[("a", 0)] == lo and rows[("a", 511)] == pytest.approx(hi) and rows[("b", 0)] == 7.0


def test_imputation_joins_missing_rows_only(spark):
    from cohortlens.operators.impute import impute_draw
    df = spark.range(2000).selectExpr("id as person_id", "if(id % 7 = 0, null, cast(id % 6 as double)) as v",
                                      "if(id % 50 = 0, null, 'big') as org")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = impute_draw(df, "v", "s", group="org")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Union" in plan and len(rows) == 2000
    assert all(r["v"] in set(range(6)) and (r["person_id"] % 7 == 0 or r["v"] == r["person_id"] % 6) for r in rows)


def test_quantiles_of_groups_and_widened_brackets(spark):
    from cohortlens.operators import quantile
    df = spark.range(4000).selectExpr("cast(id % 3 as int) as g", "cast(id * 7919 % 1009 as double) as x",
                                      "if(id % 3 = 1, null, cast(id % 13 as double)) as y")
    for accuracy in (10, 100000):                          # a coarse sketch misses and is widened
        got = quantile.grouped_quantiles(df, "g", ["x", "y"], [0.1, 0.5, 0.99], accuracy=accuracy)
        for r in df.groupBy("g").agg(*[F.percentile(c, p).alias(f"{c}_{p}") for c in "xy" for p in (0.1, 0.5, 0.99)]).collect():
            for c in "xy":
                for p in (0.1, 0.5, 0.99):
                    want = r[f"{c}_{p}"]
                    assert got[(r["g"], c, p)] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_vif_of_a_singular_set(spark):
    df = spark.range(400).selectExpr("cast(id % 37 as double) as a", "cast(2 * (id % 37) as double) as b",
                                     "cast(id * 7 % 53 as double) as c", "cast(id * id % 29 as double) as e", "5.0D as k")
    got = dict(stats.vif(df, "y", ["a", "b", "c", "e", "k"]))
    assert got["a"] == got["b"] == math.inf and 1.0 <= got["c"] < 1.2 and 1.0 <= got["e"] < 1.2 and math.isnan(got["k"])


def test_grid_fits_run_until_they_settle(spark, monkeypatch):
    from cohortlens.operators import mixture
    from cohortlens.plans import models
    asked = {}

    def fit_grid(df, cols, groups, names, **more):
        asked.update(more, groups=groups, models=names)
        return {}
    monkeypatch.setattr(mixture, "fit_grid", fit_grid)
    monkeypatch.setattr(models, "_FITS", {})
    models.mixture_grid(spark, SMALL)
    assert asked.get("max_iter") is None and len(asked["groups"]) * len(asked["models"]) == 168
