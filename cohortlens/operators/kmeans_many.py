"""Many K-means fits in one scan per pass, and Hartigan's transfers on top.

``fit_many`` advances hundreds of runs (several k, many starts) together: a
task lays all centres of one k side by side and gets the distances of a tile of
rows to all of them from one matrix product, the labels cluster by cluster over
all runs, and the sums from products with the one-hot labels. A run that has settled leaves
the pass. Products lose some digits beside plain differences, so the fits that
win are finished with ``kmeans.lloyd``, which takes differences.

``transfers`` goes on where Lloyd stops. A row of cluster a (n_a rows) may move
to b if n_b / (n_b + 1) |x - c_b|^2 < n_a / (n_a - 1) |x - c_a|^2: that is what
the total falls by when the row goes alone. In a round every row whose own
cluster or target may have changed (the *live* set) names its best move. Moves
made together can spoil each other, so the totals after the best row's, the
best hundredth's, tenth's, half's and all moves are taken in one aggregation, and the least
is kept. The best row alone always lowers the total; so the total falls in
each round, ends at a partition that no single move improves, and is never
above Lloyd's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import sq_distance
from cohortlens.operators import kmeans as km
from cohortlens.schema import ID
from cohortlens.session import write_stage

TILE_CELLS = 100_000        # distances of a tile: rows x centres, as many as stay in the core's cache


def _factors(centres: np.ndarray) -> np.ndarray:
    """What rows with a 1 beside them are multiplied by for |c|^2 - 2 x.c; ``centres``: runs x k x d, rows by cluster, then run."""
    n2 = (centres * centres).sum(axis=2)
    # a centre equal to an earlier one of its run gets no row, whatever the products' rounding
    same = (centres[:, :, None] == centres[:, None]).all(axis=3)
    n2[np.tril(same, -1).any(axis=2)] = np.inf
    return np.hstack([-2 * centres.transpose(1, 0, 2).reshape(-1, centres.shape[2]), n2.T.reshape(-1, 1)])


def _room(cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays that serve one tile after the other: fresh ones would cost as much as the distances."""
    return np.empty(cells), np.empty(cells), np.empty(cells, bool)


def _tile_sums(x1: np.ndarray, norms: np.ndarray, factors: np.ndarray, k: int, room=None) -> tuple[np.ndarray, np.ndarray]:
    """(k x runs x (sums of the measures, rows), sum of squared distances of each run) of a tile ``x1`` = (measures, 1)."""
    n, cells = len(x1), len(x1) * len(factors)
    room = room or _room(cells)
    d2 = np.matmul(factors, x1.T, out=room[0][:cells].reshape(-1, n)).reshape(k, -1, n)
    best, hit = (a[:cells // k].reshape(-1, n) for a in room[1:])
    np.copyto(best, d2[0])
    for c in range(1, k):
        np.minimum(best, d2[c], out=best)
    hits = 0
    for c in range(k):                              # the distances give way to who has which row
        np.equal(d2[c], best, out=hit)
        hits += np.count_nonzero(hit)
        np.copyto(d2[c], hit)
    if hits != best.size:                           # the lowest cluster among equals; rows that are no numbers go to the first
        d2[0][np.isnan(best)] = 1.0
        before = d2[0].copy()
        for c in range(1, k):
            d2[c] *= before == 0
            before += d2[c]
    sums = (d2.reshape(-1, n) @ x1).reshape(k, -1, x1.shape[1])
    best += norms
    return sums, np.maximum(best, 0.0, out=best).sum(axis=1)


def _pass(df: DataFrame, cols: list[str], centres: dict[int, dict[int, np.ndarray]]) -> pa.Table:
    """(run, cluster, n, sse, s0..) of all runs in one scan; ``centres``: k -> run -> k x d. A run's sse stands in its first row."""
    d = len(cols)
    stacks = [(list(by), k, _factors(np.stack(list(by.values())))) for k, by in centres.items() if by]
    steps = [max(16, TILE_CELLS // len(factors)) for _, _, factors in stacks]

    def fn(it):
        total = [None] * len(stacks)
        room = _room(max(step * len(factors) for step, (_, _, factors) in zip(steps, stacks)))
        for x in it:
            x1 = np.hstack([x, np.ones((len(x), 1))])
            norms = (x1[:, :d] * x1[:, :d]).sum(axis=1)
            for i, (_, k, factors) in enumerate(stacks):
                for s in range(0, len(x1), steps[i]):
                    got = _tile_sums(x1[s:s + steps[i]], norms[s:s + steps[i]], factors, k, room)
                    total[i] = got if total[i] is None else tuple(a + b for a, b in zip(total[i], got))
        for (runs, k, _), got in zip(stacks, total):
            if got is not None:
                flat = got[0].transpose(1, 0, 2).reshape(-1, d + 1)
                sse = np.zeros((len(runs), k))
                sse[:, 0] = got[1]
                yield pd.DataFrame({"run": np.repeat(np.array(runs, np.int32), k), "cluster": np.tile(np.arange(k, dtype=np.int32), len(runs)),
                                    "n": flat[:, d].astype(np.int64), "sse": sse.reshape(-1)} | {f"s{j}": flat[:, j] for j in range(d)})

    schema = "run int, cluster int, n bigint, sse double, " + ", ".join(f"s{j} double" for j in range(d))
    part = km.map_arrays(df, cols, fn, schema)
    return part.groupBy("run", "cluster").agg(*[F.sum(v).alias(v) for v in ["n", "sse"] + [f"s{j}" for j in range(d)]]).toArrow()


def fit_many(df: DataFrame, cols: Sequence[str], settings: dict[int, tuple[int, int]], seed: int = 123, key: str = ID,
             tol: float = 1e-9) -> km.KMeansSweep:
    """Fit every k of ``settings`` (k -> (starts, greatest number of updates)); the best run of each k is exact.

    ``best(k)`` of the result has centres, sizes, withinss, cost, iterations and ``converged``.
    """
    cols = list(cols)
    seeds = [seed + i for i in range(max(n for n, _ in settings.values()))]
    start = km.start_rows(df, cols, seeds, max(settings), key)
    runs: dict[int, km.KMeansRun] = {}
    limit: dict[int, int] = {}
    for k, (starts, most) in settings.items():
        for s in seeds[:starts]:
            limit[len(runs)] = most
            runs[len(runs)] = km.KMeansRun(k=k, seed=s, centres=start[s][:k].copy())
    active, d = set(runs), len(cols)
    df = km.spread_rows(df, cols)
    while active:
        centres: dict[int, dict[int, np.ndarray]] = {}
        for r in sorted(active):
            centres.setdefault(len(runs[r].centres), {})[r] = runs[r].centres
        order = sorted(active)
        got = _pass(df, cols, centres)
        at, c = np.searchsorted(order, got.column("run").to_numpy()), got.column("cluster").to_numpy()
        n, sse, sums = (np.zeros((len(order), max(centres), *more)) for more in ((), (), (d,)))
        n[at, c], sse[at, c] = got.column("n").to_numpy(), got.column("sse").to_numpy()
        sums[at, c] = np.column_stack([got.column(f"s{j}").to_numpy() for j in range(d)])
        for i, r in enumerate(order):
            run = runs[r]
            have = np.flatnonzero(n[i])
            new = run.centres.copy()
            new[have] = sums[i, have] / n[i, have, None]
            run.cost = float(sse[i].sum())
            moved = np.max(np.abs(new - run.centres), initial=0.0)
            run.converged = bool(moved <= tol * (1.0 + np.max(np.abs(new), initial=0.0)))
            if run.converged or run.iterations >= limit[r]:
                active.discard(r)
            else:
                run.centres, run.iterations = new, run.iterations + 1
    out = km.KMeansSweep(cols=cols)
    # runs that end in one partition differ by rounding only: the lowest seed stands for them
    best = {k: min((r for r in runs if runs[r].k == k), key=lambda r: (float(f"{runs[r].cost:.6e}"), runs[r].seed)) for k in settings}
    # the winners are finished side by side
    exact = km.lloyd(df, cols, {r: runs[r].centres for r in best.values()},
                     {r: max(0, limit[r] - runs[r].iterations) for r in best.values()})
    for k, r in best.items():
        run = exact[r]
        run.k, run.seed, run.iterations = k, runs[r].seed, run.iterations + runs[r].iterations
        out.runs.append(run)
    return out


# --- Hartigan's transfers --------------------------------------------------

@dataclass
class Transfers:
    """``rows`` (key, measures, cluster): a partition that no single move improves; clusters count from 1."""

    rows: DataFrame
    total: float
    first_total: float
    rounds: int


def moments(rows: DataFrame, cols: Sequence[str], label: Column) -> dict[int, tuple[float, np.ndarray, float]]:
    """cluster -> (rows, sums, sum of squared norms); a row per cluster reaches the driver."""
    norm = sq_distance([F.col(c) for c in cols], [F.lit(0.0)] * len(cols))
    got = rows.groupBy(label.alias("_l")).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
                                              *[F.sum(c).alias(f"s{j}") for j, c in enumerate(cols)]).collect()
    return {r["_l"]: (r["n"], np.array([r[f"s{j}"] for j in range(len(cols))]), r["q"]) for r in got}


def total_of(stats: dict) -> float:
    return float(sum(q - (s @ s) / n for n, s, q in stats.values() if n))


def best_moves(rows: DataFrame, cols: Sequence[str], stats: dict, live: set | None = None) -> DataFrame:
    """``rows`` with ``target`` and ``gain``: the best move of each row, null where none lowers the total.

    ``live``: clusters that have changed; rows whose cluster has not ask only those.
    """
    xs = [F.col(c) for c in cols]
    own, cands = F.lit(None).cast("double"), []
    for c, (n, s, _) in sorted(stats.items()):
        d2 = sq_distance(xs, [F.lit(float(v)) for v in s / n])
        here = F.col("cluster") == c
        # a row alone stays
        own = F.when(here, d2 * (n / (n - 1)) if n > 1 else F.lit(0.0)).otherwise(own)
        ask = ~here if live is None or c in live else ~here & F.col("cluster").isin(sorted(live))
        cands.append(F.when(ask, F.struct((d2 * (n / (n + 1))).alias("cost"), F.lit(c).cast("bigint").alias("to"))))
    best = F.array_min(F.filter(F.array(*cands), lambda m: m.isNotNull()))
    # gains within rounding are none, or two rounds could undo each other
    gain = F.col("_own") - F.col("_best.cost")
    good = gain > 1e-9 * (1.0 + F.col("_own"))
    return rows.withColumn("_best", best).withColumn("_own", own).select(
        *rows.columns, F.when(good, F.col("_best.to")).alias("target"), F.when(good, gain).alias("gain"))


def transfers(rows: DataFrame, cols: Sequence[str], key: str = ID) -> Transfers:
    """Move rows of (key, measures, cluster) until no single move lowers the total."""
    cols = list(cols)
    rows = rows.select(key, *[F.col(c).cast("double").alias(c) for c in cols], F.col("cluster").cast("bigint").alias("cluster"))
    stats = moments(rows, cols, F.col("cluster"))
    first = total = total_of(stats)
    live, rounds = None, 0
    while True:
        moved = write_stage(best_moves(rows, cols, stats, live), "transfers")
        asks = moved.where("target is not null")
        q = asks.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gain", [0.5, 0.9, 0.99], 1000).alias("cuts"),
                     F.max(F.struct(F.col("gain"), (-F.col(key)).alias("k"))).alias("best")).first()
        if not q["n"]:
            if live is None:
                return Transfers(rows, total, first, rounds)
            live = None                         # the live clusters are done: all rows once more
            continue
        # the best row alone; the smallest key among equal gains
        one = F.coalesce((F.col("gain") == q["best"]["gain"]) & (F.col(key) == -q["best"]["k"]), F.lit(False))
        options = [F.col("target").isNotNull() & (F.col("gain") >= c) for c in (0.0, *q["cuts"])] + [one]
        tried = []
        # moved rows only: what a choice takes from and gives to each cluster
        norm = sq_distance([F.col(c) for c in cols], [F.lit(0.0)] * len(cols))
        flow = asks.select(F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(-1.0).alias("sign")),
                                             F.struct(F.col("target").alias("c"), F.lit(1.0).alias("sign")))).alias("m"),
                           *cols, key, "gain", "target", norm.alias("_q"))
        sums = []
        for i, o in enumerate(options):
            w = F.when(o, F.col("m.sign")).otherwise(0.0)
            sums += [F.sum(w).alias(f"n{i}"), F.sum(w * F.col("_q")).alias(f"q{i}")]
            sums += [F.sum(w * F.col(c)).alias(f"s{i}_{j}") for j, c in enumerate(cols)]
        flows = flow.groupBy(F.col("m.c").alias("c")).agg(*sums).collect()
        for i, o in enumerate(options):
            new = {c: [n, s.copy(), q_] for c, (n, s, q_) in stats.items()}
            for r in flows:
                new[r["c"]][0] += r[f"n{i}"]
                new[r["c"]][1] += np.array([r[f"s{i}_{j}"] for j in range(len(cols))])
                new[r["c"]][2] += r[f"q{i}"]
            if all(v[0] > 0 for v in new.values()):       # no cluster is emptied
                tried.append((total_of(new), i))
        if not tried or min(tried)[0] >= total:
            return Transfers(rows, total, first, rounds)
        _, pick = min(tried)
        touched = asks.where(options[pick]).select(F.explode(F.array("cluster", "target")).alias("c")).distinct().collect()
        live = {r["c"] for r in touched}
        rows = write_stage(moved.withColumn("cluster", F.when(options[pick], F.col("target")).otherwise(F.col("cluster")))
                           .select(key, *cols, "cluster"), "transfers")
        stats = moments(rows, cols, F.col("cluster"))
        total, rounds = total_of(stats), rounds + 1


def hartigan(df: DataFrame, cols: Sequence[str], k: int, nstart: int = 1, max_iter: int = 1000, seed: int = 123, key: str = ID
             ) -> Transfers:
    """Lloyd from random rows, then transfers."""
    fit = fit_many(df, cols, {k: (nstart, max_iter)}, seed, key).best(k)
    return transfers(km.assign(df, list(cols), fit.centres).select(key, *cols, "cluster"), cols, key)
