"""Hand-made edge cases (small literal fixtures)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.columns import lenient_double, snake_case
from cohortlens.operators import clean, dbscan, evaluate, impute, outliers, stats


def test_snake_case():
    assert snake_case("Person ID") == "person_id"
    assert snake_case("orgIdProvider") == "org_id_provider"
    assert snake_case("  A.  Care--contacts ") == "a_care_contacts"


def test_lenient_cast(spark):
    df = spark.createDataFrame([("NULL",), ("",), ("NA",), ("1e3",), (" 2.5 ",)], "v string")
    got = [r[0] for r in df.select(lenient_double("v")).collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == 1000.0 and got[4] == 2.5


def test_duplicated_person_drops_all_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "person_id bigint, x double")
    assert [r.person_id for r in clean.drop_duplicated(df).collect()] == [2]


def test_missing_count_counts_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (None, 1.0)], "person_id bigint, x double")
    assert clean.missing_count(df).first()[0] == 3


def test_impute_single_value_and_fallbacks(spark):
    rows = [(i, "A", 7.0) for i in range(5)] + [(10 + i, "A", None) for i in range(20)]
    rows += [(40 + i, "B", float(i % 3)) for i in range(6)] + [(60 + i, "C", None) for i in range(30)]
    rows += [(100 + i, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, "person_id bigint, org string, v double")
    out = impute.impute_draw(df, "v", "t", group="org").toPandas()
    assert out["v"].notna().all()
    assert set(out[out.org == "A"]["v"]) == {7.0}                      # org with one distinct value
    assert set(out[out.org.isin(["C"]) | out.org.isna()]["v"]) <= {0.0, 1.0, 2.0, 7.0}
    assert len(out) == len(rows)


def test_impute_distribution_is_respected(spark):
    rows = [(i, 1.0 if i < 300 else 2.0) for i in range(400)] + [(1000 + i, None) for i in range(4000)]
    df = spark.createDataFrame(rows, "person_id bigint, v double")
    out = impute.impute_draw(df, "v", "dur").where("person_id >= 1000").toPandas()
    share = (out["v"] == 1.0).mean()
    assert abs(share - 0.75) < 0.03


def test_outlier_equal_to_quantile_is_kept(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(100)], "person_id bigint, x double")
    assert outliers.remove_outliers(df, ["x"]).count() == 100


def test_constant_column_zscore_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "person_id bigint, c double, x double")
    r = stats.zscore(df, ["c", "x"]).orderBy("person_id").collect()
    assert r[0]["c"] is None and r[0]["x"] == pytest.approx(-1 / math.sqrt(2))


def test_group_zscore_constant_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "person_id bigint, name string, value double")
    assert [r.value_scale for r in stats.group_zscore(df).collect()] == [None, None]


def test_join_labels_unknown_name_kept(spark):
    from cohortlens.operators.reshape import join_labels
    from cohortlens.sources.lookups import measure_lookup
    df = spark.createDataFrame([(1, "nope", 1.0)], "person_id bigint, name string, value double")
    r = join_labels(df, measure_lookup(spark)).first()
    assert r.variable_clean is None


def _brute_sil(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_matches_brute_force_and_singleton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    lab = np.array([1] * 30 + [2] * 29 + [3])     # cluster 3 is a singleton
    rows = [(i, int(lab[i]), *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "person_id bigint, cluster bigint, a double, b double, c double")
    sil = evaluate.silhouette_rows(df, ["a", "b", "c"], block_rows=16)
    got = sil.agg(F.avg("s")).first()[0]
    assert got == pytest.approx(_brute_sil(x, lab), abs=1e-12)
    assert sil.where("cluster = 3").first()["s"] == 0.0


def test_adjusted_rand_identical_and_single_cluster(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "person_id bigint, a bigint")
    b = a.withColumnRenamed("a", "b")
    assert evaluate.adjusted_rand(a, b).first()[0] == pytest.approx(1.0)
    one = spark.createDataFrame([(i, 1) for i in range(10)], "person_id bigint, a bigint")
    assert evaluate.adjusted_rand(one, one.withColumnRenamed("a", "b")).first()[0] == 1.0


def test_optimum_model_tie_takes_first(spark):
    m = spark.createDataFrame([("K-means", 1, 0.5, 1.0, 10.0), ("LPA", 2, 0.5, 1.0, 10.0)],
                              "model string, model_order int, silhouette_score double, db_index double, wcss double")
    assert evaluate.optimum_model(evaluate.score_models(m)).first()["model"] == "K-means"


def test_dbscan_border_tie_and_exact_eps(spark):
    # cluster A: a1 at (-2, 0) plus 4 rows at (-3.5, 0); cluster C mirrored at +x.
    # The row at the origin is exactly eps from a1 and c1 and has 3 neighbours:
    # a border row reachable from both clusters.
    pts = [(1, -2.0, 0.0)] + [(i, -3.5, 0.0) for i in range(2, 6)]
    pts += [(6, 2.0, 0.0)] + [(i, 3.5, 0.0) for i in range(7, 11)]
    pts += [(11, 0.0, 0.0), (12, 0.0, 50.0)]
    df = spark.createDataFrame(pts, "person_id bigint, x double, y double")
    lab = {r.person_id: r for r in dbscan.dbscan(df, ["x", "y"], eps=2.0, min_pts=5).collect()}
    assert lab[1].cluster == 1 and lab[6].cluster == 2
    assert lab[11].cluster == 1 and not lab[11].is_core          # reachable from both: lowest number
    assert lab[12].cluster == 0                                   # noise
    assert lab[1].n_neighbours == 6                               # self + 4 + the row exactly eps away


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.5, (80, 3)), rng.normal(3, 0.5, (80, 3)), rng.uniform(-4, 7, (40, 3))])
    rows = [(i + 1, *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "person_id bigint, a double, b double, c double")
    got = {r.person_id: r.cluster for r in dbscan.dbscan(df, ["a", "b", "c"], eps=0.6, min_pts=5,
                                                          block_rows=32).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    nb = d <= 0.6
    core = nb.sum(1) >= 5
    comp = -np.ones(len(x), int)
    c = 0
    for i in range(len(x)):
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], c
            while stack:
                j = stack.pop()
                for t in np.nonzero(nb[j] & core)[0]:
                    if comp[t] < 0:
                        comp[t] = c
                        stack.append(t)
            c += 1
    for i in range(len(x)):
        want = comp[i] + 1 if core[i] else (comp[nb[i] & core].min() + 1 if (nb[i] & core).any() else 0)
        assert got[i + 1] == want


def test_convex_hull_contains_all_points(spark):
    from cohortlens.operators.hull import convex_hulls
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(400, 2))
    rows = [(i, i % 2, float(p[0]), float(p[1])) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "person_id bigint, cluster bigint, x double, y double").repartition(4)
    hull = convex_hulls(df).toPandas()
    for c in (0, 1):
        h = hull[hull.cluster == c].sort_values("vertex")[["x", "y"]].to_numpy()
        sub = pts[np.arange(400) % 2 == c]
        for p in sub:
            for a, b in zip(h, np.roll(h, -1, axis=0)):
                assert (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9
