"""Distances by products against plain differences; work that must spread over tasks; sized shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import dbscan as db
from cohortlens.operators import evaluate as ev
from cohortlens.operators import kmeans as km
from cohortlens.operators import kmeans_many as kk
from cohortlens.operators import leaves as lv
from cohortlens.operators import pairs
from cohortlens.operators.sampling import sample_key
from cohortlens.session import ROWS_PER_TASK, sized_shuffles

AB = ["a", "b"]


def _rows(n=700, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 1000.0                # far from the origin: a product alone would lose digits
    x[n // 2:n // 2 + 40] = x[0]                        # copies
    return x


def test_products_decide_as_differences():
    x, y = _rows(), _rows(seed=4)
    y[:50] = x[:50]
    y[50:60] = x[50:60] + np.array([0.5, 0, 0, 0, 0])    # at the limit itself
    d2 = pairs._by_differences(x, y)
    for eps2 in (0.25, 3.0):
        n, _ = pairs.count_within(x, pairs.Blocks(y, 64), eps2)
        assert (n == (d2 <= eps2).sum(axis=1)).all()
        assert (pairs.within(x, y, eps2) == (d2 <= eps2)).all()
        some, _ = pairs.count_within(x, pairs.Blocks(y, 64), eps2, 3)
        assert (np.minimum(some, 3) == np.minimum(n, 3)).all()


def test_k_nearest_is_exact():
    x = _rows()
    ids = np.arange(len(x))
    d2 = pairs._by_differences(x, x)
    np.fill_diagonal(d2, np.inf)
    want = np.sort(d2, axis=1)[:, :4]
    assert (pairs.k_nearest(x, ids, pairs.Blocks(x, 64), ids, 4) == want).all()
    got = pairs.k_nearest(x, ids, pairs.Blocks(x, 64), ids, 4, bound=want[:, 3])
    assert (got == want).all()
    assert np.isinf(pairs.k_nearest(x[:2], ids[:2], pairs.Blocks(x[:2]), ids[:2], 4)[:, 1:]).all()


@pytest.mark.parametrize("bad", [None, np.nan, np.inf])
def test_group_sums_match_plain_sums(bad):
    x, y = _rows(), _rows(300, seed=5)
    if bad is not None:
        y[7, 2] = bad
    gx, gy = np.arange(len(x)) % 3, np.arange(len(y)) % 4
    with np.errstate(invalid="ignore"):
        d = np.sqrt(pairs._by_differences(x, y))
        a, b = pairs.group_sums(x, gx, y, gy, 4, False)
    want_a = np.stack([d[:, gy == g].sum(axis=1) for g in range(4)], axis=1)
    want_b = np.stack([d[gx == g].sum(axis=0) for g in range(4)], axis=1)
    assert np.allclose(a, want_a, rtol=1e-9, equal_nan=True) and np.allclose(b, want_b, rtol=1e-9, equal_nan=True)
    own, none = pairs.group_sums(x, gx, x, gx, 3, True)
    d = np.sqrt(pairs._by_differences(x, x))
    assert np.allclose(own, np.stack([d[:, gx == g].sum(axis=1) for g in range(3)], axis=1), rtol=1e-9) and not none.any()


def test_equal_rows_have_no_width(spark):
    df = spark.createDataFrame([(i, i % 2, 1234.5, 0.1) for i in range(20)], "person_id bigint, cluster bigint, a double, b double")
    assert [r["s"] for r in ev.silhouette_rows(df, AB).collect()] == [0.0] * 20


def test_all_labels_share_one_pass(spark):
    x = np.random.default_rng(2).normal(size=(90, 2))
    rows = [(i, i % 3, None if i == 5 else i % 4, *map(float, x[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "person_id bigint, p bigint, q bigint, a double, b double")
    both = ev.silhouettes(df, AB, ["p", "q"])
    for got, label in zip(both, "pq"):
        assert got == pytest.approx(ev.silhouette(df, AB, label).first()[0], abs=1e-12)
    assert ev.label_widths(df, AB, ["q"]).where("q is null").select("s_q").collect()[0][0] == 0.0


def test_neighbour_counts_are_those_of_all_pairs(spark):
    x = np.random.default_rng(8).normal(size=(400, 2))
    rows = [(i, *map(float, x[i])) for i in range(400)] + [(400, None, 0.0)]
    df = spark.createDataFrame(rows, "person_id bigint, a double, b double")
    want = (pairs._by_differences(x, x) <= 0.5 ** 2).sum(axis=1)
    got = {r[0]: (r[1], r[2]) for r in db.neighbour_counts(df, AB, 0.5, 9, leaf_rows=40).collect()}
    assert got == {i: (int(n), bool(n >= 9)) for i, n in enumerate(want)} | {400: (0, False)}


def test_leaves_are_not_gathered_in_one_task(spark):
    df = spark.range(4000).select(F.col("id").alias("person_id"), (F.col("id") % 61).cast("double").alias("a"),
                                  (F.col("id") % 67).cast("double").alias("b"))
    tree = lv.grow(df, AB, leaf_rows=250)
    parts = (lv.dealt(tree.rows, "leaf").groupBy("leaf")
             .applyInArrow(lambda k, t: t.select(["person_id"]).slice(0, 1), "person_id bigint")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_shuffles_grow_with_the_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with sized_shuffles(spark, 40 * ROWS_PER_TASK):
        assert int(spark.conf.get(name)) == max(40, int(before))
    assert spark.conf.get(name) == before
    with sized_shuffles(spark, 1):
        assert spark.conf.get(name) == before


def test_tile_sums_of_many_fits_match_plain_assignment():
    from cohortlens.operators import kmeans as km
    from cohortlens.operators import kmeans_many as kk
    rng = np.random.default_rng(6)
    x, centres = rng.normal(size=(300, 3)), rng.normal(size=(7, 4, 3))
    x1 = np.hstack([x, np.ones((300, 1))])
    sums, sse = kk._tile_sums(x1, (x * x).sum(axis=1), kk._factors(centres), 4)
    for run, c in enumerate(centres):
        d2 = km._sqdist(x, c)
        lab = d2.argmin(axis=1)
        assert (sums[:, run, 3] == np.bincount(lab, minlength=4)).all()
        assert np.allclose(sums[:, run, :3], [x[lab == k].sum(axis=0) for k in range(4)])
        assert sse[run] == pytest.approx(d2.min(axis=1).sum())


def test_winners_keep_their_own_limits(spark):
    from cohortlens.operators import kmeans as km
    x = np.random.default_rng(7).normal(size=(200, 2))
    df = spark.createDataFrame([(i, *map(float, x[i])) for i in range(200)], "person_id bigint, a double, b double")
    got = km.lloyd(df, AB, {0: x[:3], 1: x[3:8]}, {0: 1, 1: 4})
    for r, most in ((0, 1), (1, 4)):
        alone = km.lloyd(df, AB, {r: x[:3] if r == 0 else x[3:8]}, most)[r]
        assert (got[r].centres == alone.centres).all() and got[r].iterations == alone.iterations == most


def test_fits_of_one_start_are_summed_once_and_densities_hold():
    import pandas as pd
    from cohortlens.operators import mixture as mx
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 2))
    cov = np.stack([np.array([[1.0, 0.3], [0.3, 2.0]]), np.eye(2) * 0.5])
    fit = mx.Fit("VVV", 2, pi=np.array([0.4, 0.6]), mu=rng.normal(size=(2, 2)), sigma=cov)
    state = ("soft", mx._prepare(fit))
    plain = np.stack([np.log(fit.pi[k]) - 0.5 * (2 * mx.LOG2PI + np.linalg.slogdet(cov[k])[1]
                      + np.einsum("ni,ij,nj->n", x - fit.mu[k], np.linalg.inv(cov[k]), x - fit.mu[k])) for k in range(2)], axis=1)
    assert np.allclose(mx._log_density(x, *state[1]), plain)
    got = pd.concat(mx._estep(AB, {4: state, 5: state})(iter([pd.DataFrame(x, columns=AB)])))
    assert got["fit"].tolist() == [4, 4, 5, 5] and (got[got["fit"] == 4].drop(columns="fit").to_numpy()
                                                     == got[got["fit"] == 5].drop(columns="fit").to_numpy()).all()
    assert got["nk"].sum() == pytest.approx(2 * 2500)
    assert got["ll"].sum() == pytest.approx(2 * np.logaddexp(plain[:, 0], plain[:, 1]).sum())


def test_every_two_blocks_meet_in_a_task_of_their_own(spark):
    """F16 to F19, F21: cuts from a sample can give one task several pairs of blocks."""
    df = spark.range(2000).toDF("i")
    met = ev.meetings(df, "i", 7).withColumn("task", F.spark_partition_id())
    assert met.groupBy("i").agg(F.countDistinct("_pair").alias("n")).where("n != 7").count() == 0
    tasks = met.groupBy("task").agg(F.countDistinct("_lo", "_hi").alias("n")).collect()
    assert [r["n"] for r in tasks] == [1] * 28
    # grouping takes the rows where they are
    plan = met.groupBy("_pair").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_ask_only_pieces_near_themselves(monkeypatch):
    """F11 to F13, F20: one row in need of far pieces had sent all rows of its block there."""
    rng = np.random.default_rng(8)
    y = rng.uniform(0, 100, size=(4096, 2))
    ids = np.arange(len(y))
    d2 = pairs._by_differences(y, y)
    np.fill_diagonal(d2, np.inf)
    want = np.sort(d2, axis=1)[:, :3]
    bound = want[:, 2].copy()
    bound[::20] = 1e6
    taken, found = [], pairs.found
    monkeypatch.setattr(pairs, "found", lambda mask: (taken.append(mask.size), found(mask))[1])
    assert (pairs.k_nearest(y, ids, pairs.Blocks(y), ids, 3, bound) == want).all()
    assert sum(taken) < len(y) ** 2 / 4
    monkeypatch.undo()
    x = y[::16]                                         # one block as wide as everything
    n, work = pairs.count_within(x, pairs.Blocks(y), 1.0, 10_000)
    assert (n == (pairs._by_differences(x, y) <= 1.0).sum(axis=1)).all()
    assert work < len(x) * len(y) / 4


def test_equal_starts_and_rows_that_are_no_numbers_go_to_the_lowest_cluster():
    """F8: a tile in arrays that are used again; equal centres were parted by the products' rounding alone."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(301, 11)) + 30.0
    x[5, 2] = np.nan
    runs = rng.normal(size=(37, 7, 11)) + 30.0
    runs[:, 4] = runs[:, 1]
    runs[3] = runs[3, 0]
    x1, ok = np.hstack([x, np.ones((len(x), 1))]), np.arange(len(x)) != 5
    factors = kk._factors(runs)
    room = tuple(np.full(301 * 37 * 7 + 50, 9).astype(t) for t in (float, float, bool))
    with np.errstate(invalid="ignore"):
        sums, sse = kk._tile_sums(x1, (x * x).sum(axis=1), factors, 7, room)
    for r in range(37):
        d2 = np.where(ok[:, None], pairs._by_differences(x, runs[r]), 0.0)
        lab = d2.argmin(axis=1)
        assert (sums[:, r, 11] == np.bincount(lab, minlength=7)).all()
        assert np.isnan(sse[r])
    assert (sums[4, :, 11] == 0).all() and sums[0, 3, 11] == 301
    again = kk._tile_sums(x1[ok], (x[ok] ** 2).sum(axis=1), factors, 7, room)
    fresh = kk._tile_sums(x1[ok], (x[ok] ** 2).sum(axis=1), factors, 7)
    assert all((a == b).all() for a, b in zip(again, fresh))


def test_starts_are_the_rows_with_the_least_keys(spark):
    df = spark.range(3000).selectExpr("id AS i", "double(id) AS a").coalesce(1)
    got = km.start_rows(df, ["a"], [1, 2], 5, "i")
    for s in (1, 2):
        want = [r["a"] for r in df.orderBy(sample_key("i", s), "i").limit(5).collect()]
        assert got[s][:, 0].tolist() == want
