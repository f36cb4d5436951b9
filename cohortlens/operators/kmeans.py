"""K-means on Spark: batched Lloyd iterations.

All fits of a sweep (several k, several random starts) advance together:
one pass over the data per iteration, where each task assigns its rows to
the nearest centre of *every* active run with numpy and emits only partial
sums per (run, cluster).  Spark aggregates those (k x d numbers per run)
and the driver computes the new centres.  So the sweep costs as many scans
as the slowest run needs iterations, not fits x iterations.

Starts are R-style "random rows": the k rows with the smallest
md5(id | seed), found with a per-seed top-k (partition-local, then
merged).  Ties in distance go to the lowest cluster number; an empty
cluster keeps its centre.  Labels of a fitted model are a JVM expression
(distances + array_min), no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import sq_distance
from cohortlens.operators.partials import combine
from cohortlens.operators.sampling import sample_keys
from cohortlens.schema import ID
from cohortlens.session import ROWS_PER_TASK, ship_package, write_stage

TILES = "fit_tile"          # the only column of rows that are stored for many passes: blocks of measures as bytes


@dataclass
class KMeansRun:
    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("nan")
    iterations: int = 0
    converged: bool = False
    sizes: np.ndarray | None = None
    withinss: np.ndarray | None = None


@dataclass
class KMeansSweep:
    cols: list[str]
    runs: list[KMeansRun] = field(default_factory=list)

    def best(self, k: int) -> KMeansRun:
        cands = [r for r in self.runs if r.k == k]
        return min(cands, key=lambda r: (r.cost, r.seed))


def start_rows(df: DataFrame, cols: Sequence[str], seeds: Sequence[int], k_max: int,
               key: str = ID) -> dict[int, np.ndarray]:
    """Per seed, the k_max rows with the smallest md5 key (ordered).

    One scan for all seeds: a task takes the keys of all seeds in arrays and keeps
    k_max rows a seed. Rows without an id have no key and come after all others of a task.
    """
    ship_package(df.sparkSession)
    cols, seeds = list(cols), list(seeds)
    d = len(cols)
    src = df.select(F.col(key).cast("bigint").alias("_id"), F.col(key).cast("string").alias("_text"),
                    *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    no_key = np.iinfo(np.int64).max

    def top(batches):
        best = [None] * len(seeds)
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(1).fill_null("").cast(pa.large_binary())
            _, off, raw = text.buffers()
            off = np.frombuffer(off, np.int64)[text.offset:text.offset + len(text) + 1]
            every = sample_keys(np.frombuffer(raw or b"", np.uint8), off, seeds)
            every[:, batch.column(1).is_null().to_numpy(zero_copy_only=False)] = no_key
            ids, x = batch.column(0).to_pandas(), pd.DataFrame(_measures(batch.select(range(2, 2 + d))), columns=[f"c{j}" for j in range(d)])
            for i, keys in enumerate(every):
                have = best[i]
                # only what can be among the first is sorted: up to the k_max-th key, here or so far
                cut = have["_k"].iloc[-1] if have is not None and len(have) == k_max else no_key
                if len(keys) > k_max:
                    cut = min(cut, np.partition(keys, k_max - 1)[k_max - 1])
                pick = np.flatnonzero(keys <= cut)
                if len(pick):
                    part = pd.concat([pd.DataFrame({"_k": keys[pick], "_id": ids.iloc[pick].to_numpy()}), x.iloc[pick].reset_index(drop=True)], axis=1)
                    part = part if have is None else pd.concat([have, part])
                    best[i] = part.sort_values(["_k", "_id"]).head(k_max)
        for seed, part in zip(seeds, best):
            if part is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), seed, np.int32)), pa.array(part["_k"].to_numpy(), mask=(part["_k"] == no_key).to_numpy()),
                     pa.array(part["_id"], pa.int64(), from_pandas=True), *[pa.array(part[f"c{j}"], from_pandas=True) for j in range(d)]],
                    names=["_seed", "_k", "_id"] + [f"c{j}" for j in range(d)])

    schema = "_seed int, _k bigint, _id bigint, " + ", ".join(f"c{j} double" for j in range(d))
    w = Window.partitionBy("_seed").orderBy("_k", "_id")     # tasks x k_max rows per seed
    rows = (src.mapInArrow(top, schema).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k_max).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["_seed"], r["_rn"])):
        out.setdefault(r["_seed"], []).append([r[f"c{j}"] for j in range(d)])
    return {s: np.array(v, dtype=float) for s, v in out.items()}


def _sqdist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """n x k squared distances, summed coordinate by coordinate (left to right)."""
    acc = np.zeros((x.shape[0], c.shape[0]))
    for j in range(x.shape[1]):
        diff = x[:, j, None] - c[None, :, j]
        acc += diff * diff
    return acc


def map_arrays(df: DataFrame, cols: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn`` (rows x measures arrays of a task -> frames of ``schema``) over a table or what ``spread_rows`` made of it."""
    ship_package(df.sparkSession)
    d, tiled = len(cols), df.columns == [TILES]

    def arrays(batches):
        for batch in batches:
            if tiled:
                for tile in batch.column(0):
                    yield np.frombuffer(tile.as_buffer(), float).reshape(-1, d)
            elif batch.num_rows:
                yield _measures(batch)

    def run(batches):
        for frame in fn(arrays(batches)):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return (df if tiled else df.select(*[F.col(c).cast("double").alias(c) for c in cols])).mapInArrow(run, schema)


def _measures(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns; null is no number."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _partial_sums(d, centres_by_run):
    def fn(it):
        total = {run: [np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros((len(c), d))]
                 for run, c in centres_by_run.items()}
        for x in it:
            for run, c in centres_by_run.items():
                d2 = _sqdist(x, c)
                lab = np.argmin(d2, axis=1)
                k = c.shape[0]
                cnt, sse, sums = total[run]
                cnt += np.bincount(lab, minlength=k)
                sse += np.bincount(lab, weights=d2[np.arange(len(x)), lab], minlength=k)
                for j in range(d):
                    sums[:, j] += np.bincount(lab, weights=x[:, j], minlength=k)
        frames = []
        for run, (cnt, sse, sums) in total.items():
            f = pd.DataFrame({"run": np.full(len(cnt), run, np.int32), "cluster": np.arange(len(cnt), dtype=np.int32), "n": cnt, "sse": sse})
            for j in range(d):
                f[f"s{j}"] = sums[:, j]
            frames.append(f[f["n"] > 0])
        yield pd.concat(frames, ignore_index=True)
    return fn


def _partials(df, cols, centres_by_run) -> DataFrame:
    """Tasks x components rows of sums."""
    schema = "run int, cluster int, n bigint, sse double, " + ", ".join(f"s{j} double" for j in range(len(cols)))
    return map_arrays(df, cols, _partial_sums(len(cols), centres_by_run), schema)


def _pass(df, cols, centres_by_run):
    return combine(_partials(df, cols, centres_by_run), ["run", "cluster"],
                   ["n", "sse"] + [f"s{j}" for j in range(len(cols))])


def spread_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The measures for a fit that reads them in every pass: blocks of rows as bytes, which need no row of Spark any more.

    There are as many pieces as cores, or a multiple, so that none has much over ``ROWS_PER_TASK`` rows.
    """
    ship_package(df.sparkSession)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    cores = df.sparkSession.sparkContext.defaultParallelism

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_measures(batch).tobytes()], pa.binary())], names=[TILES])

    parts = cores * max(1, -(-rows.count() // (cores * ROWS_PER_TASK)))
    return write_stage(rows.repartition(parts).mapInArrow(pack, f"{TILES} binary"), "fit-rows")


def lloyd(df: DataFrame, cols: Sequence[str], starts: dict[int, np.ndarray], max_iter: int | dict[int, int],
          tol: float = 1e-12) -> dict[int, KMeansRun]:
    """Run Lloyd iterations for several runs at once.

    ``starts`` maps run id -> initial centres (k x d).  A run stops when its
    centres no longer move beyond rounding (or after ``max_iter`` updates); the reported cost,
    sizes and withinss are those of the final centres.  ``max_iter`` may be
    given run by run.
    """
    cols = list(cols)
    d = len(cols)
    most = max_iter if isinstance(max_iter, dict) else dict.fromkeys(starts, max_iter)
    runs = {r: KMeansRun(k=c.shape[0], seed=-1, centres=c.copy()) for r, c in starts.items()}
    active = set(runs)
    it = 0
    while True:
        current = {r: runs[r].centres for r in active}
        rows = _pass(df, cols, current)
        stats = {r: (np.zeros(runs[r].k), np.zeros(runs[r].k), np.zeros((runs[r].k, d))) for r in active}
        for row in rows:
            n, sse, sums = stats[int(row["run"])]
            c = int(row["cluster"])
            n[c], sse[c] = row["n"], row["sse"]
            sums[c] = [row[f"s{j}"] for j in range(d)]
        finished = set()
        for r in active:
            n, sse, sums = stats[r]
            run = runs[r]
            run.cost, run.sizes, run.withinss = float(sse.sum()), n.astype(int), sse
            if it >= most[r]:
                finished.add(r)
                continue
            new = run.centres.copy()
            nz = n > 0
            new[nz] = sums[nz] / n[nz, None]
            moved = np.max(np.abs(new - run.centres)) if len(new) else 0.0
            run.centres = new
            run.iterations = it + 1
            if moved <= tol * (1.0 + np.max(np.abs(new), initial=0.0)):
                run.converged = True
                finished.add(r)
        active -= finished
        it += 1
        if not active:
            break
    return runs


def fixed_steps(df: DataFrame, cols: Sequence[str], start: np.ndarray, steps: int) -> np.ndarray:
    """Centres after exactly ``steps`` Lloyd updates (no early stop)."""
    c = start.copy()
    d = len(cols)
    for _ in range(steps):
        rows = _pass(df, cols, {0: c})
        new = c.copy()
        for row in rows:
            new[int(row["cluster"])] = [row[f"s{j}"] / row["n"] for j in range(d)]
        c = new
    return c


def sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int], nstart: int = 1, max_iter: int = 10,
          seed: int = 123, key: str = ID) -> KMeansSweep:
    """Fit k-means for every k in ``ks`` with ``nstart`` random starts each."""
    seeds = [seed + i for i in range(nstart)]
    start = start_rows(df, cols, seeds, max(ks), key)
    starts, meta = {}, {}
    rid = 0
    for k in ks:
        for s in seeds:
            starts[rid] = start[s][:k]
            meta[rid] = (k, s)
            rid += 1
    runs = lloyd(df, cols, starts, max_iter)
    out = KMeansSweep(cols=list(cols))
    for r, run in runs.items():
        run.k, run.seed = meta[r]
        out.runs.append(run)
    return out


def assign(df: DataFrame, cols: Sequence[str], centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """Nearest-centre label (1-based) as a JVM expression; ties -> lowest label."""
    xs = [F.col(c).cast("double") for c in cols]
    cands = []
    for i, c in enumerate(centres):
        d2 = sq_distance(xs, [F.lit(float(v)) for v in c])
        cands.append(F.struct(d2.alias("d2"), F.lit(i + 1).alias("label")))
    return df.withColumn(out, F.array_min(F.array(*cands))["label"].cast("bigint"))


def assign_all(df: DataFrame, cols: Sequence[str], centres: dict[str, np.ndarray], key: str = ID) -> DataFrame:
    """(key, label of every named fit): many fits at once, which would be too long as one expression."""
    ship_package(df.sparkSession)
    cols = list(cols)

    def fn(it):
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=float)
            yield pd.DataFrame({key: pdf[key]} | {n: np.argmin(_sqdist(x, c), axis=1) + 1 for n, c in centres.items()})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        fn, f"{key} bigint, " + ", ".join(f"{n} bigint" for n in centres))


def centres_table(spark, cols: Sequence[str], centres: np.ndarray) -> DataFrame:
    rows = [(i + 1, *map(float, c)) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cluster bigint, " + ", ".join(f"{c} double" for c in cols))
