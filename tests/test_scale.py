"""Leaves, DBSCAN and kNN over them, fast silhouettes, many K-means fits, pair-plot data, saved models."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import dbscan as db
from cohortlens.operators import density_scan as ds
from cohortlens.operators import kmeans as km
from cohortlens.operators import kmeans_many as kk
from cohortlens.operators import leaves as lv
from cohortlens.operators import mixture as mx
from cohortlens.operators import pairplot as pp
from cohortlens.operators import silhouette_fast as sf
from cohortlens.operators import stats
from cohortlens.schema import ID
from cohortlens.sources import bundles

AB = ["a", "b"]


@pytest.fixture(scope="module")
def points(spark):
    """Two clouds, scattered rows, and a third of all rows at one place."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (200, 2)), rng.normal(6, .5, (150, 2)), rng.uniform(-10, 10, (60, 2)), np.full((200, 2), 20.0)])
    pdf = pd.DataFrame(x, columns=AB)
    pdf.insert(0, ID, rng.permutation(len(pdf)) + 1)
    return spark.createDataFrame(pdf).cache()


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_leaves_are_bounded_and_boxes_hold_their_rows(points):
    tree = lv.grow(points, AB, leaf_rows=25)
    assert sum(r.n for r in tree.boxes.collect()) == 610 == tree.rows.count()
    assert max(r.n for r in tree.boxes.collect()) <= 50           # the 200 equal rows are dealt by hash
    assert tree.rows.join(tree.boxes, "leaf").where(lv.row_to_box(AB) > 0).count() == 0
    boxes = tree.boxes.collect()

    def gap(p, q):
        return math.sqrt(sum(max(p[f"lo_{c}"] - q[f"hi_{c}"], q[f"lo_{c}"] - p[f"hi_{c}"], 0) ** 2 for c in AB))
    reach = tree.boxes.select("leaf", F.lit(1.5).alias("r"))
    want = sorted((p.leaf, q.leaf) for p in boxes for q in boxes if gap(p, q) <= 1.5)
    assert table(lv.near_leaves(tree, reach), "leaf", "to") == want


@pytest.mark.parametrize("eps", [0.3, 3.0])
def test_dbscan_over_leaves_equals_counting_all_neighbours(points, eps):
    fit = ds.dbscan_leaves(points, AB, eps, 5, leaf_rows=25)
    want = table(db.dbscan(points, AB, eps, 5), ID, "cluster", "is_core")
    assert table(fit.labels, ID, "cluster", "is_core") == want
    # rows that were fitted get their own label back
    assert table(ds.assign(fit, points), ID, "cluster") == [w[:2] for w in want]


def test_dbscan_leaves_out_what_cells_and_bounds_settle(spark):
    """Ten times the rows: the distances per row do not grow, and the large cluster's rows are not sent about."""
    rng = np.random.default_rng(5)
    per_row, moved = [], []
    for n in (400, 4000):
        pdf = pd.DataFrame(rng.normal(0, 1, (n, 2)), columns=AB).assign(**{ID: range(n)})
        work = ds.dbscan_leaves(spark.createDataFrame(pdf), AB, 1.0, 5, leaf_rows=100).work
        per_row.append(sum(w[2] for w in work) / n)
        moved.append(dict((w[0], w[1]) for w in work)["parts not yet tied"] / n)
    assert per_row[1] < 2 * per_row[0] + 10 and max(moved) < 0.05


def test_new_rows_take_the_lowest_cluster_in_reach(spark, points):
    fit = ds.dbscan_leaves(points, AB, 1.0, 5, leaf_rows=25)
    new = spark.createDataFrame([(1, 20.5, 20.0), (2, 500.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0)], f"{ID} long, a double, b double")
    got = dict(table(ds.assign(fit, new), ID, "cluster"))
    here = {r.cluster for r in fit.cores.where("a = 20").collect()}
    assert {got[1]} == here and got[2] == got[3] == got[4] == 0


def test_dbscan_and_knn_take_odd_rows_and_no_rows(spark):
    rows = [(i, 1.0, 1.0) for i in range(6)] + [(10, None, 1.0), (11, float("nan"), 0.0), (12, 9.0, 9.0)]
    df = spark.createDataFrame(rows, f"{ID} long, a double, b double")
    got = {r[0]: (r[1], r[2]) for r in table(ds.dbscan_leaves(df, AB, 0.5, 5).labels, ID, "cluster", "is_core")}
    assert got == {i: (1, True) for i in range(6)} | {i: (0, False) for i in (10, 11, 12)}
    assert {r[0] for r in table(ds.knn_leaves(df, AB, 3), ID)} == {0, 1, 2, 3, 4, 5, 12}
    assert ds.dbscan_leaves(df.limit(0), AB, 0.5, 5).labels.count() == 0 == ds.knn_leaves(df.limit(0), AB, 3).count()


def test_knn_over_leaves_equals_all_pairs(points):
    got = ds.knn_leaves(points, AB, 5, leaf_rows=25).toPandas().sort_values(ID)
    want = db.knn_distance(points, AB, 5).toPandas().sort_values(ID)
    assert np.allclose(got.knn_dist, want.knn_dist) and got.visits.mean() < 8


def brute_widths(pdf, square):
    x, c = pdf[AB].to_numpy(), pdf.cluster.to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if square else np.sqrt(d)
    out = []
    for i in range(len(x)):
        means = {k: d[i, c == k].sum() / max((c == k).sum() - (k == c[i]), 1) for k in set(c)}
        a, b = means.pop(c[i]), min(means.values(), default=None)
        out.append(0.0 if (c == c[i]).sum() < 2 or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


def test_fast_silhouettes_match_brute_force(spark, points):
    labelled = points.withColumn("cluster", F.when(F.col(ID) == 7, 9).otherwise(F.col(ID) % 3))
    pdf = labelled.toPandas().sort_values(ID)
    got = sf.squared_rows(labelled, AB).toPandas().sort_values(ID)
    assert np.allclose(got.s, brute_widths(pdf, True))
    asked = labelled.where(f"{ID} % 10 = 1 or {ID} = 7")
    want = pdf.assign(s=brute_widths(pdf, False)).set_index(ID).s
    for r in sf.sampled_rows(labelled, asked, AB).collect():
        assert r.s == pytest.approx(want[r[ID]])
    near = db.knn_distance(points, AB, 4).toPandas().set_index(ID).knn_dist
    found = sf.sampled_knn(points, asked, AB, 4).collect()
    assert len(found) == asked.count() and all(r.knn_dist == pytest.approx(near[r[ID]]) for r in found)


def test_fast_silhouettes_of_odd_tables(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 3.0, 4.0, 1), (3, None, 0.0, 1), (4, 1.0, 1.0, None)],
                                f"{ID} long, a double, b double, cluster long")
    assert [(r[ID], r.s) for r in sf.squared_rows(one, AB).orderBy(ID).collect()] == [(1, 0.0), (2, 0.0)]
    assert sf.squared_rows(one.limit(0), AB).count() == sf.sampled_rows(one.limit(0), one.limit(0), AB).count() == 0
    with pytest.raises(ValueError):
        sf.sampled_knn(spark.range(sf.MAX_QUERIES + 1).select(F.col("id").alias(ID), F.rand(1).alias("a"), F.rand(2).alias("b")),
                       spark.range(sf.MAX_QUERIES + 1).select(F.col("id").alias(ID), F.rand(1).alias("a"), F.rand(2).alias("b")), AB, 2)


def test_many_fits_equal_single_fits(points):
    many = kk.fit_many(points, AB, {3: (4, 50), 4: (2, 50)})
    one = km.sweep(points, AB, [3], nstart=4, max_iter=50)
    assert many.best(3).cost == pytest.approx(one.best(3).cost) and many.best(3).converged
    assert many.best(4).sizes.sum() == 610 and len(many.best(4).centres) == 4


def test_transfers_end_where_no_single_move_helps(points):
    lloyd = kk.fit_many(points, AB, {5: (1, 100)}).best(5)
    done = kk.hartigan(points, AB, 5, 1, 100)
    assert done.first_total == pytest.approx(lloyd.cost) and done.total <= done.first_total + 1e-9
    pdf = done.rows.toPandas()
    x, c = pdf[AB].to_numpy(), pdf.cluster.to_numpy()

    def total(c):
        return sum(((x[c == k] - x[c == k].mean(axis=0)) ** 2).sum() for k in set(c.tolist()))
    assert total(c) == pytest.approx(done.total)
    n = {k: (c == k).sum() for k in set(c.tolist())}
    mean = {k: x[c == k].mean(axis=0) for k in n}
    for i in range(len(x)):
        if n[c[i]] > 1:
            leave = n[c[i]] / (n[c[i]] - 1) * ((x[i] - mean[c[i]]) ** 2).sum()
            assert all(n[k] / (n[k] + 1) * ((x[i] - mean[k]) ** 2).sum() > leave - 1e-6 * (1 + leave) for k in n if k != c[i])


def test_transfers_leave_a_bad_start(spark):
    """A partition far from any optimum: every round lowers the total, clusters are never emptied."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(9, 1, (60, 2))]), columns=AB)
    pdf[ID], pdf["cluster"] = range(120), [1 + i % 2 for i in range(120)]
    done = kk.transfers(spark.createDataFrame(pdf), AB)
    assert done.rounds >= 1 and done.total < done.first_total / 3
    assert sorted(r["count"] for r in done.rows.groupBy("cluster").count().collect()) == [60, 60]


def test_pair_plot_data(spark, points):
    df = points.withColumn("cluster", (F.col(ID) % 2).cast("long")).withColumn("b", F.when(F.col(ID) != 3, F.col("b")))
    got = pp.density_by_group(df, "cluster", AB, grid=64).toPandas()
    assert len(got) == 2 * 2 * 64
    for _, part in got.groupby(["cluster", "name"]):                  # a curve over its range holds most of the mass
        assert 0.5 < np.trapezoid(part.sort_values("x").density, part.sort_values("x").x) <= 1.001
    hist = pp.histogram_by_group(df, "cluster", AB)
    assert {(r.name, r.n) for r in hist.groupBy("name").agg(F.sum("n").alias("n")).collect()} == {("a", 610), ("b", 609)}
    flat = spark.createDataFrame([(1, 5.0, None), (1, 5.0, None), (None, 1.0, 1.0)], "cluster long, a double, b double")
    assert [(r.name, r.bin, r.n) for r in pp.histogram_by_group(flat, "cluster", AB).collect()] == [("a", 0, 2)]
    assert pp.density_by_group(flat, "cluster", AB, grid=16).count() == 16
    assert pp.density_by_group(flat.limit(0), "cluster", AB).count() == 0


def test_models_come_back_as_they_were(spark, points, tmp_path):
    points = points.where("a < 15")
    fit = mx.fit_grid(points, AB, [2], ["VVI"])[(2, "VVI")]
    pca = bundles.PCAModel.of(stats.PCAFit(points, AB))
    centres = np.array([[0.0, 0.0], [6.0, 6.0], [20.0, 20.0]])
    models = {"k": bundles.KMeansModel(AB, centres), "m": bundles.MixtureModel(AB, fit), "p": pca}
    path = bundles.save(spark, f"{tmp_path}/one", {"rows": points.limit(5)}, models)
    back = bundles.load(spark, path)
    assert back.tables["rows"].count() == 5
    assert table(back.models["k"].label(points), ID, "cluster") == table(km.assign(points, AB, centres), ID, "cluster")
    assert table(back.models["m"].label(points), ID, "cluster", "uncertainty") == table(mx.classify(points, AB, fit), ID, "cluster", "uncertainty")
    assert table(back.models["p"].scores(points), ID, "PC1", "PC2") == table(pca.scores(points), ID, "PC1", "PC2")
    with pytest.raises(bundles.BundleError):
        bundles.save(spark, path)


def test_half_written_bundles_are_refused(spark, points, tmp_path, monkeypatch):
    path = f"{tmp_path}/half"
    points.limit(2).write.parquet(f"{path}/rows")
    with pytest.raises(bundles.BundleError, match="manifest"):
        bundles.load(spark, path)
    whole = bundles.save(spark, f"{tmp_path}/whole", {"rows": points.limit(2), "more": points.limit(3)})
    points.limit(1).write.mode("overwrite").parquet(f"{whole}/more")
    with pytest.raises(bundles.BundleError, match="more"):
        bundles.load(spark, whole)
    monkeypatch.setattr(bundles, "VERSION", 2)
    with pytest.raises(bundles.BundleError, match="version"):
        bundles.load(spark, whole)


def test_responsibilities_add_up(points):
    spread = points.where("a < 15")
    fit = mx.fit_grid(spread, AB, [2], ["VVI"])[(2, "VVI")]
    got = mx.responsibilities(spread, AB, fit)
    assert got.count() == 820
    assert got.groupBy(ID).agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9").count() == 0


def test_merge_tree_matches_brute_force():
    from cohortlens.operators import agglomerate as ag
    rng = np.random.default_rng(2)
    rows = [rng.normal(rng.uniform(-4, 4, 2), rng.uniform(.2, 1, 2), (rng.integers(1, 30), 2)) for _ in range(12)]
    stat = lambda x: (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    n, mean, w = (np.array([stat(x)[i] for x in rows]) for i in range(3))
    got = ag.merge_order(n, mean, w, ridge=0.05)
    held = dict(enumerate(rows))

    def cost(x):
        return len(x) * np.log(np.linalg.det(stat(x)[2] / len(x) + 0.05 * np.eye(2)))
    for i, j in got:
        def rise(p, q):
            return cost(np.vstack([held[p], held[q]])) - cost(held[p]) - cost(held[q])
        best = min(rise(p, q) for p in held for q in held if p < q)
        assert rise(i, j) == pytest.approx(best, abs=1e-8)
        held[i] = np.vstack([held[i], held.pop(j)])
    assert len(held) == 1 and [len(set(ag.groups_left(12, got, g).tolist())) for g in (1, 3, 12, 20)] == [1, 3, 12, 12]


def test_agglomerative_starts(points):
    from cohortlens.operators import agglomerate as ag
    spread = points.where("a < 15")
    part = ag.partitions(spread, AB, [1, 2], micro=20)[2]
    x = spread.toPandas()[AB].to_numpy()
    lab = part.group[((x[:, None] - part.centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    for k in range(2):
        assert np.allclose(part.means[k], x[lab == k].mean(axis=0))
    fit = mx.fit_grid(spread, AB, [2], ["VVV"], start="agglomerative")[(2, "VVV")]
    other = mx.fit_grid(spread, AB, [2], ["VVV"])[(2, "VVV")]
    assert fit.converged and fit.loglik >= other.loglik - 5
    tiny = ag.partitions(points.limit(3), AB, [1, 5], micro=20)
    assert len(tiny[5].means) <= 3 and len(tiny[1].means) == 1


def test_raw_measures_write_the_persons_before_the_joins(spark, tmp_path):
    """Days are sorted in one step and joined to none; gaps and late contacts of odd persons."""
    from cohortlens.sources.measures import key_measures_raw
    days = {1: ["2020-01-01", "2020-06-01", "2020-06-01", "2020-06-02"], 2: ["2020-03-03"], 3: [None], 4: [None, "2020-01-01", "2021-01-01"]}
    lines, orders = [], []
    for person, dates in days.items():
        for i, day in enumerate(dates):
            orders.append((person * 10 + i, person, "1-URGENT" if i else "5-LOW"))
            lines.append((person * 10 + i, i % 2, 2.0, "R", "F", day))
    orders.append((99, None, "5-LOW"))
    lines.append((99, 0, 1.0, "N", "O", "2020-01-01"))
    tables = {"lineitem": (lines, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate string"),
              "orders": (orders, "o_orderkey long, o_custkey long, o_orderpriority string"),
              "customer": ([(p, 1, "BUILDING", 10000.0 if p == 2 else 1.0) for p in days],
                           "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = key_measures_raw(spark, str(tmp_path))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.person_id, r.care_contacts, r.length_care, r.intermittent_care_periods, r.contact_prop_aft_midpoint)
                 for r in out.where("person_id <> 3").collect())
    assert got == [(1, 4.0, 153.0, "1.0", 0.75), (2, 1.0, 0.0, "NULL", 0.0), (2, 1.0, 0.0, "NULL", 0.0), (4, 3.0, 366.0, "1.0", pytest.approx(1 / 3))]
    null = out.where("person_id = 3").first()
    assert (null.care_contacts, null.length_care, null.contact_prop_aft_midpoint) == (1.0, None, 0.0)


def test_start_rows_are_those_with_the_smallest_keys(spark, monkeypatch):
    """The keys of all seeds are taken in arrays: no expression of Spark for each seed and row."""
    import hashlib
    from cohortlens.operators import sampling

    ids = [3, -7, 0, 10, 99, 12345, 10 ** 12, -2 ** 63, *range(200, 260)]
    df = spark.createDataFrame([(i, float(n)) for n, i in enumerate(ids)], "person_id long, a double").repartition(3)
    monkeypatch.setattr(sampling, "sample_key", lambda *a: pytest.fail("a key was taken by Spark"))
    got = km.start_rows(df, ["a"], [123, 4567], 5)
    for seed in (123, 4567):
        order = sorted(ids, key=lambda i: int(hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:15], 16))
        assert got[seed][:, 0].tolist() == [ids.index(i) for i in order[:5]]
    texts = ["", "x" * 40, "y" * 41, "é" * 60, "5"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    assert sampling.sample_keys(np.frombuffer(raw, np.uint8), off, [9])[0].tolist() == [
        int(hashlib.md5(f"{t}|9".encode()).hexdigest()[:15], 16) for t in texts]
