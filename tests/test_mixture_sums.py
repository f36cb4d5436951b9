"""Sums of a mixture pass by products for all fits at once, beside sums by differences."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import mixture as mx
from cohortlens.schema import GRID_MODELS


def fits(x, groups, seed=1):
    rng, out = np.random.default_rng(seed), []
    for g in groups:
        c = x[rng.choice(len(x), g, replace=False)]
        r = np.exp(-((x[:, None] - c) ** 2).sum(axis=2) / 4)
        r /= r.sum(axis=1, keepdims=True)
        nk = r.sum(axis=0)
        mu = (r.T @ x) / nk[:, None]
        w = np.stack([((x - mu[k]) * r[:, k, None]).T @ (x - mu[k]) for k in range(g)])
        for m in GRID_MODELS:
            out.append(("soft", mx._prepare(mx.Fit(m, g, nk / nk.sum(), mu, mx.m_step(m, nk, w)))))
    return dict(enumerate(out))


def test_sums_by_products_are_those_by_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4)) @ rng.normal(size=(4, 4)) + rng.integers(0, 3, (700, 1)) * 3
    cols = list("abcd")
    states = fits(x, (1, 2, 5))
    tables = [next(mx._estep(cols, states, careful)([pd.DataFrame(x, columns=cols)])).to_numpy()
              for careful in (frozenset(), frozenset(states))]
    assert tables[0] == pytest.approx(tables[1], rel=1e-8, abs=1e-8)


def test_all_fits_share_the_products_of_a_tile(monkeypatch):
    """Fits that are not narrow take no pass of their own over a tile's rows."""
    x = np.random.default_rng(0).normal(size=(300, 3))
    monkeypatch.setattr(mx, "_responsibilities", lambda *a: pytest.fail("a fit was summed alone"))
    rows = next(mx._estep(list("abc"), fits(x, (2, 3)))([pd.DataFrame(x, columns=list("abc"))]))
    assert len(rows) == 14 * 5


def test_a_pass_sums_the_cells_of_all_tasks(spark):
    x = np.random.default_rng(0).normal(size=(300, 3))
    states = fits(x, (2, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(3)
    got = mx._pass(df, list("abc"), states)
    nk, ll, sx, sxx = got[20]
    r, want = mx._responsibilities(x, states[20])
    assert nk == pytest.approx(r.sum(axis=0)) and ll == pytest.approx(want) and sx == pytest.approx(r.T @ x)
    assert sxx == pytest.approx(mx._scatter(x, mx._shift(states[20]), r)) and len(got) == 28
    assert not mx._pass(df.limit(0), list("abc"), states)[0][0].any()


def test_narrow_components_go_by_differences():
    nk, mu = np.array([50.0, 50.0]), np.array([[1.0, 0.0], [0.0, 3.0]])
    wide = np.stack([np.eye(2), np.eye(2)])
    flat = np.stack([np.eye(2), np.diag([1.0, 1e-12])])
    assert not mx._narrow(wide, nk, mu, wide * 50) and mx._narrow(flat, nk, mu, flat * 50)
    assert mx._narrow(np.full((2, 2, 2), np.nan), nk, mu, wide)


def test_a_grid_starts_from_the_merge_tree(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(120, 2)), rng.normal(size=(80, 2)) + 9])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(person_id=range(200))).repartition(3)
    fits = mx.fit_grid(df, ["a", "b"], [1, 2], ["EII", "VVV"], start="agglomerative")
    assert all(f.converged for f in fits.values())
    assert sorted(fits[2, "VVV"].pi) == pytest.approx([0.4, 0.6], abs=1e-3)
    own = np.cov(x.T, bias=True)
    assert fits[1, "VVV"].sigma[0] == pytest.approx(own, rel=1e-9)


def test_a_narrow_scatter_alone_takes_no_pass_by_differences(spark, monkeypatch):
    """Equal shapes keep a component wide where its own rows are not; only its scatter goes by differences."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) * [1, 1, 0] + 6])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(person_id=range(300))).repartition(3)
    real, asked = mx._pass, []

    def run(rows, cols, states, careful=frozenset(), flat={}):
        asked.append((set(careful), dict(flat)))
        return real(rows, cols, states, careful, flat)

    monkeypatch.setattr(mx, "_pass", run)
    fits = mx.fit_grid(df, list("abc"), [2], ["VEE", "VEV"], start="agglomerative")
    assert fits[2, "VEE"].converged and fits[2, "VEV"].converged
    assert not any(careful for careful, _ in asked) and [len(v) for v in asked[-1][1].values()] in ([], [1])
    assert any(flat for _, flat in asked)


def test_components_of_one_fit_go_by_products_or_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4)) + 1e3
    states = fits(x, (3,))
    whole, scatter, both = (next(mx._estep(list("abcd"), states, careful, flat)([x])).to_numpy() for careful, flat in
                            ((frozenset(states), {}), ({}, {f: (0, 2) for f in states}), ({f: frozenset((0, 2)) for f in states}, {})))
    for got in (scatter, both):
        assert got[:, 2:8] == pytest.approx(whole[:, 2:8], rel=1e-6)
        assert got[:, 8:] == pytest.approx(whole[:, 8:], abs=1e-4)
    noise = np.abs(both - whole)[:, 8:].max(axis=1).reshape(-1, 3)
    assert noise[:, [0, 2]].max() < noise[:, 1].min()


def test_shares_too_small_to_matter_are_normal_numbers():
    logp = np.array([[[0.0, -5000.0], [-700.0, 0.0]]])
    ll = mx._shares(logp)
    assert ll.tolist() == [[0.0, 0.0]] and logp.min() >= np.finfo(float).tiny and logp.max() == 1.0
