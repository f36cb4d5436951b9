"""Silhouettes that do not meet every pair: by cluster moments, and for a bounded set of rows.

* ``squared_rows``: with squared Euclidean distances the mean distance of a row
  to a cluster follows from the cluster's moments (rows n, sum S, sum Q of
  squared norms): sum |x - y|^2 = n |x|^2 - 2 x.S + Q. One aggregation gives
  the moments, one scan the widths: O(rows x clusters) and no pair. Measures are
  centred on their means first, so that the three terms stay of like size.
* ``sampled_rows`` / ``sampled_knn``: up to ``MAX_QUERIES`` rows are broadcast,
  every task meets them with its own rows in tiles and hands over one partial
  result per query row (and cluster), and the partials are summed or merged.
  The values are the exact ones that those rows have against *all* rows.

Defined results: rows with a null measure or label are left out; a row alone in
its cluster, or the only cluster, has width 0; equal rows have width 0 where
both means are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.dbscan import TILE, _dist2
from cohortlens.operators.leaves import measures, usable
from cohortlens.schema import ID
from cohortlens.session import ship_package

MAX_QUERIES = 20_000        # rows that are broadcast: 20,000 x 11 doubles are 1.8 MB
MAX_CLUSTERS = 10_000       # moments that are broadcast


def _width(a: Column, b: Column, n: Column) -> Column:
    return (F.when((n <= 1) | b.isNull(), F.lit(0.0))
            .otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))))


def squared_rows(df: DataFrame, cols: Sequence[str], label: str = "cluster", key: str = ID) -> DataFrame:
    """(key, label, a, b, s) with squared Euclidean distances, for every labelled row."""
    ship_package(df.sparkSession)
    cols = list(cols)
    rows = df.where(usable(cols) & F.col(label).isNotNull()).select(
        key, F.col(label).cast("bigint").alias(label), *[F.col(c).cast("double").alias(c) for c in cols])
    mean = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centre = np.array([mean[c] or 0.0 for c in cols])
    at = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, centre)]
    norm = sum((x * x for x in at[1:]), at[0] * at[0])
    got = (rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
                                   *[F.sum(x).alias(f"s{j}") for j, x in enumerate(at)])
           .orderBy(label).limit(MAX_CLUSTERS + 1).collect())
    if len(got) > MAX_CLUSTERS:
        raise ValueError(f"over {MAX_CLUSTERS} clusters: their moments would outgrow the broadcast")
    names = np.array([r[label] for r in got], np.int64)
    n = np.array([r["n"] for r in got], float)
    q = np.array([r["q"] for r in got])
    s = np.array([[r[f"s{j}"] for j in range(len(cols))] for r in got]).reshape(len(got), len(cols))

    def widths(batches):
        for batch in batches:
            x = measures(pa.Table.from_batches([batch]), cols) - centre
            if not len(x):
                continue
            total = (x * x).sum(axis=1)[:, None] * n[None, :] - 2 * x @ s.T + q[None, :]
            total = np.maximum(total, 0.0)
            mine = np.searchsorted(names, batch.column(1).to_numpy())
            row = np.arange(len(x))
            with np.errstate(divide="ignore", invalid="ignore"):
                a = total[row, mine] / (n[mine] - 1)
                others = total / n[None, :]
            others[row, mine] = np.inf
            b = others.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(a, mask=n[mine] < 2), pa.array(b, mask=np.isinf(b)),
                 pa.array(n[mine].astype(np.int64))], names=[key, label, "a", "b", "n"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.mapInArrow(widths, f"{key} {kind}, {label} bigint, a double, b double, n bigint")
    return out.select(key, label, "a", "b", _width(F.col("a"), F.col("b"), F.col("n")).alias("s"))


def _queries(df: DataFrame, queries: DataFrame, cols: Sequence[str], key: str, extra: Sequence[str] = ()) -> pa.Table:
    got = queries.join(df.where(usable(cols)), key, "left_semi") if queries is not df else df
    table = got.select(key, *extra, *[F.col(c).cast("double").alias(c) for c in cols]).limit(MAX_QUERIES + 1).toArrow()
    if table.num_rows > MAX_QUERIES:
        raise ValueError(f"over {MAX_QUERIES} query rows: they would outgrow the broadcast")
    return table.sort_by(key).combine_chunks()


def sampled_rows(df: DataFrame, queries: DataFrame, cols: Sequence[str], label: str = "cluster", key: str = ID) -> DataFrame:
    """(key, label, a, b, s): exact Euclidean silhouette widths of the ``queries`` against all rows of ``df``.

    ``queries`` has the columns of ``df``; a query's own row is found by its key.
    """
    ship_package(df.sparkSession)
    cols = list(cols)
    rows = df.where(usable(cols) & F.col(label).isNotNull()).select(
        key, F.col(label).cast("bigint").alias(label), *[F.col(c).cast("double").alias(c) for c in cols])
    asked = _queries(rows, queries.where(F.col(label).isNotNull()), cols, key, [F.col(label).cast("bigint").alias(label)])
    shared = rows.sparkSession.sparkContext.broadcast((measures(asked, cols), asked.column(key).to_numpy(),
                                                       asked.column(label).to_numpy()))

    def sums(batches):
        x, ids, _ = shared.value
        held: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            y = measures(pa.Table.from_batches([batch]), cols)
            names, code = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            onehot = np.zeros((len(y), len(names)))
            onehot[np.arange(len(y)), code.reshape(-1)] = 1.0
            part = np.zeros((len(x), len(names)))
            for t in range(0, len(y), TILE):
                for s in range(0, len(x), TILE):
                    part[s:s + TILE] += np.sqrt(_dist2(x[s:s + TILE], y[t:t + TILE])) @ onehot[t:t + TILE]
            for j, name in enumerate(names.tolist()):
                old, n = held.get(name, (0.0, 0))
                held[name] = old + part[:, j], n + int(onehot[:, j].sum())
        for name, (d, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), name)), pa.array(d),
                                              pa.array(np.full(len(ids), n))], names=["id", "ref", "sum_d", "n"])

    per = rows.mapInArrow(sums, "id bigint, ref bigint, sum_d double, n bigint").groupBy("id", "ref").agg(
        F.sum("sum_d").alias("sum_d"), F.sum("n").alias("n"))
    own = rows.sparkSession.createDataFrame(asked.select([key, label]).rename_columns(["id", "own"]).to_pandas(), "id bigint, own bigint")
    is_own = F.col("ref") == F.col("own")
    per = per.join(own, "id").groupBy("id", "own").agg(
        F.max(F.when(is_own, F.col("n"))).alias("n"), F.max(F.when(is_own, F.col("sum_d"))).alias("d"),
        F.min(F.when(~is_own, F.col("sum_d") / F.col("n"))).alias("b"))
    a = F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1))
    return per.select(F.col("id").alias(key), F.col("own").alias(label), a.alias("a"), "b", _width(a, F.col("b"), F.col("n")).alias("s"))


def sampled_knn(df: DataFrame, queries: DataFrame, cols: Sequence[str], k: int, key: str = ID) -> DataFrame:
    """(key, knn_dist): exact distance of each query to its k-th nearest other row of ``df``; none without k others."""
    ship_package(df.sparkSession)
    cols = list(cols)
    rows = df.where(usable(cols)).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    asked = _queries(rows, queries, cols, key)
    shared = rows.sparkSession.sparkContext.broadcast((measures(asked, cols), asked.column(key).to_numpy()))

    def nearest(batches):
        x, ids = shared.value
        best = np.full((len(x), k), np.inf)
        for batch in batches:
            y, other = measures(pa.Table.from_batches([batch]), cols), batch.column(0).to_numpy()
            for t in range(0, len(y), TILE):
                for s in range(0, len(x), TILE):
                    d2 = _dist2(x[s:s + TILE], y[t:t + TILE])
                    d2[ids[s:s + TILE][:, None] == other[t:t + TILE][None, :]] = np.inf
                    best[s:s + TILE] = np.partition(np.hstack([best[s:s + TILE], d2]), k - 1, axis=1)[:, :k]
        best.sort(axis=1)
        ok = np.isfinite(best)
        if ok.any():
            edge = np.append(0, np.cumsum(ok.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(best[ok]))],
                                             names=["id", "near"])

    # at most k distances from each task
    near = rows.mapInArrow(nearest, "id bigint, near array<double>").groupBy("id").agg(
        F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    return near.where(F.size("near") >= k).select(F.col("id").alias(key), F.sqrt(F.get("near", F.lit(k - 1))).alias("knn_dist"))
