import numpy as np
import pytest

from cohortlens.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 5])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for _ in range(12):
        c = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((n, [float(x) for x in np.float32(c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3]))]))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [x * 7 for x in rows[0][1]]), (n + 3, [0.0] * 16),
             (n + 4, None), (n + 5, [float("nan")] * 16), (n + 6, [None] * 16), (n + 7, []), (n + 8, rows[0][1][:8]),
             (n + 9, [float("inf")] + [1.0] * 15), (n + 10, [1e30] * 16), (n + 11, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                               "vec_id long, embedding array<float>, id int, links string").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.embedding_components(df).collect())
    assert got == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.embedding_components(df).count() == 0
    one = spark.createDataFrame([(None, None, 1), (4, [0.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(str(tuple(r)) for r in E.embedding_components(one).collect()) == ["(4, 0, 4, True)", "(None, 0, None, True)"]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    k, tables = E.plan(100_000, 64, 0.9, 1e-4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = E.codes(x, 64, k, tables, 7)[0], E.codes(0.9 * x + np.sqrt(0.19) * z, 64, k, tables, 7)[0]
    met = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)])
    assert met.mean() >= 0.998
