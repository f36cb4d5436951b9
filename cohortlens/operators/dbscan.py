"""Density-based clustering (DBSCAN) and k-nearest-neighbour distances.

Exact DBSCAN without a pair table:

1. Grid: rows fall into cells of width eps on the ``grid_dims`` widest
   measures (|x_i - y_i| <= eps on any subset of coordinates is necessary
   for distance <= eps, so candidates are exact).  Cells with many rows are
   split into sub-blocks of about ``block_rows`` rows by hash: what a task
   holds twice.  Copies of a row grow with the rows of its neighbouring cells
   over ``block_rows``; they are shuffled, never stored.
2. Every (query block, neighbouring reference block) pair is one group of
   an ``applyInPandas``; numpy goes through its distances in tiles and emits only
   per-row results: neighbour counts (core flag), a spanning forest of the
   core-core links of the group (at most rows - 1 edges, via union-find),
   and for border rows the smallest reachable core label.
3. Connected components of the core forest by min-label propagation with
   pointer jumping, checkpointed every round (lineage stays short; a lost
   executor costs one round).
4. Cluster number = rank of the smallest core ``person_id`` of the
   component; a border row takes the lowest reachable cluster number;
   everything else is noise (0).  MinPts counts the row itself, and
   distance exactly eps is a neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.schema import DBSCAN_EPS, DBSCAN_MIN_PTS, ID
from cohortlens.operators.evaluate import block_count
from cohortlens.operators.prefix import running_total
from cohortlens.session import cut_lineage, ship_package, write_stage

BLOCK_ROWS = 50_000
TILE = 1024


def _dist2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    acc = np.zeros((a.shape[0], b.shape[0]))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        acc += diff * diff
    return acc


def grid_dims(df: DataFrame, cols: Sequence[str], eps: float, m: int = 2) -> list[str]:
    """The m measures with the most eps-wide cells (best pruning)."""
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).first()
    return sorted(cols, key=lambda c: -(row[c] or 0.0))[:m]


def block_groups(df: DataFrame, cols: Sequence[str], eps: float, dims: Sequence[str],
                 key: str = ID, block_rows: int = BLOCK_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """Union of query (role 0) and reference (role 1) copies keyed by block pair ``_g``.

    Every query row meets every reference row of the neighbouring cells
    (3^m cell offsets) exactly once.
    """
    m = len(dims)
    base = df.select(key, *keep, *[F.col(c).cast("double").alias(c) for c in cols],
                     F.array(*[F.floor(F.col(c) / eps).cast("bigint") for c in dims]).alias("_cell"))
    sizes = base.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_subs", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")).drop("_n")
    # cells table: one row per occupied cell; AQE broadcasts it when small.
    pts = base.join(sizes, "_cell").withColumn("_sub", F.pmod(F.xxhash64(F.col(key)), F.col("_subs")).cast("int"))
    offsets = [[((o // (3 ** j)) % 3) - 1 for j in range(m)] for o in range(3 ** m)]
    off = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
    nb_cell = F.transform(F.col("_off"), lambda v, i: F.col("_cell")[i] + v)

    # neighbour cells that exist, with their block counts
    nbrs = (sizes.select(F.col("_cell").alias("_c"), F.explode(off).alias("_off"))
            .select("_c", F.transform(F.col("_off"), lambda v, i: F.col("_c")[i] + v).alias("_nc"))
            .join(sizes.select(F.col("_cell").alias("_nc"), F.col("_subs").alias("_nsubs")), "_nc"))

    q = (pts.join(nbrs.withColumnRenamed("_c", "_cell"), "_cell")
         .withColumn("_rsub", F.explode(F.sequence(F.lit(0), F.col("_nsubs") - 1)))
         .withColumn("_g", F.struct(F.col("_cell").alias("qc"), F.col("_sub").alias("qs"),
                                    F.col("_nc").alias("rc"), F.col("_rsub").alias("rs")))
         .withColumn("_role", F.lit(0)))
    r = (pts.join(nbrs.select(F.col("_nc").alias("_cell"), F.col("_c").alias("_qc")), "_cell")
         .join(sizes.select(F.col("_cell").alias("_qc"), F.col("_subs").alias("_qsubs")), "_qc")
         .withColumn("_qsub", F.explode(F.sequence(F.lit(0), F.col("_qsubs") - 1)))
         .withColumn("_g", F.struct(F.col("_qc").alias("qc"), F.col("_qsub").alias("qs"),
                                    F.col("_cell").alias("rc"), F.col("_sub").alias("rs")))
         .withColumn("_role", F.lit(1)))
    cols_out = [key, *keep, *cols, "_g", "_role"]
    return q.select(*cols_out).unionByName(r.select(*cols_out))


def _tiles(xq: np.ndarray, xr: np.ndarray):
    """(query rows, reference rows, squared distances) in tiles."""
    for a in range(0, len(xq), TILE):
        for b in range(0, len(xr), TILE):
            s, t = slice(a, a + TILE), slice(b, b + TILE)
            yield s, t, _dist2(xq[s], xr[t])


def _neighbour_counts(cols, key, eps2):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        if q.empty or r.empty:
            return pd.DataFrame({key: pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        xq, xr = q[cols].to_numpy(float), r[cols].to_numpy(float)
        n = np.zeros(len(xq), np.int64)
        for s, t, d2 in _tiles(xq, xr):
            n[s] += (d2 <= eps2).sum(axis=1)
        return pd.DataFrame({key: q[key].to_numpy(), "n": n})
    return fn


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes along the links (i, j)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _core_forest(cols, key, eps2):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["core"]]
        q, r = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        empty = pd.DataFrame({"src": pd.Series([], dtype="int64"), "dst": pd.Series([], dtype="int64")})
        if q.empty or r.empty:
            return empty
        ids, where = np.unique(np.concatenate([q[key].to_numpy(), r[key].to_numpy()]), return_inverse=True)
        root = np.arange(len(ids))
        for s, t, d2 in _tiles(q[cols].to_numpy(float), r[cols].to_numpy(float)):
            qi, ri = np.nonzero(d2 <= eps2)
            i, j = where[s.start + qi], where[len(q) + t.start + ri]
            new = root[i] != root[j]
            if new.any():                                  # the forest so far and the new links
                root = _forest(len(ids), np.concatenate([np.arange(len(ids)), i[new]]), np.concatenate([root, j[new]]))
        tied = root != np.arange(len(ids))
        return pd.DataFrame({"src": ids[root[tied]], "dst": ids[tied]})
    return fn


NO_COMPONENT = np.iinfo(np.int64).max


def _border_labels(cols, key, eps2):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[(pdf["_role"] == 0) & (~pdf["core"])]
        r = pdf[(pdf["_role"] == 1) & (pdf["core"])]
        empty = pd.DataFrame({key: pd.Series([], dtype="int64"), "comp": pd.Series([], dtype="int64")})
        if q.empty or r.empty:
            return empty
        comp, best = r["comp"].to_numpy(np.int64), np.full(len(q), NO_COMPONENT)
        for s, t, d2 in _tiles(q[cols].to_numpy(float), r[cols].to_numpy(float)):
            best[s] = np.minimum(best[s], np.where(d2 <= eps2, comp[None, t], NO_COMPONENT).min(axis=1))
        ok = best < NO_COMPONENT
        return pd.DataFrame({key: q[key].to_numpy()[ok], "comp": best[ok]})
    return fn


def connected_components(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """(id, comp): smallest id of each connected component.

    Min-label propagation over the edges plus pointer jumping (label of the
    label), checkpointed each round, repeated until no label changes (no
    round cap: the result is always the exact component minimum).
    """
    und = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) \
        .unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    und = cut_lineage(und)
    lab = cut_lineage(nodes.select(F.col(node).alias("id"), F.col(node).alias("comp")))
    while True:
        prop = (und.join(lab.withColumnRenamed("id", "b").withColumnRenamed("comp", "cb"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("cb").alias("cn")))
        step = lab.join(prop, "id", "left").select("id", F.least("comp", F.coalesce("cn", "comp")).alias("comp"))
        jump = (step.join(step.select(F.col("id").alias("comp"), F.col("comp").alias("cc")), "comp", "left")
                .select("id", F.least("comp", F.coalesce("cc", "comp")).alias("comp")))
        new = cut_lineage(jump)
        changed = new.join(lab.withColumnRenamed("comp", "old"), "id").where(F.col("comp") != F.col("old")).limit(1).count()
        lab = new
        if changed == 0:
            break
    return lab


def neighbour_counts(df: DataFrame, cols: Sequence[str], eps: float = DBSCAN_EPS, min_pts: int = DBSCAN_MIN_PTS,
                     key: str = ID, leaf_rows: int | None = None, tree=None) -> DataFrame:
    """(key, n_neighbours, is_core): the exact number of rows within eps of each row, itself included.

    Over leaves: a row counts its own leaf and visits the others within eps; rows with a null or NaN measure have
    no neighbour. ``tree``: the leaves of ``df`` if they stand already.
    """
    from cohortlens.operators import density_scan as ds, leaves as lv
    cols = list(cols)
    tree = tree or lv.grow(df, cols, key, leaf_rows)
    rows = tree.rows.select(key, *cols, "leaf")

    def own(_, table):
        x = lv.measures(table, cols)
        n, _taken = ds.count_to(x, x, eps, None)
        return pa.table({key: table.column(key), "n": n})

    def come(here, guests):
        n, _taken = ds.count_to(lv.measures(guests, cols), lv.measures(here, cols), eps, None)
        return pa.table({key: guests.column(key), "n": n})

    schema = f"{key} bigint, n bigint"
    far = write_stage(ds._guests(tree, rows, eps, own=False), "count-guests")
    counts = (lv.dealt(rows, "leaf").groupBy("leaf").applyInArrow(own, schema).unionByName(lv.visit(rows, far, come, schema, key))
              .unionByName(df.where(~lv.usable(cols)).select(F.col(key).cast("bigint").alias(key), F.lit(0).cast("bigint").alias("n"))))
    return (counts.groupBy(key).agg(F.sum("n").cast("bigint").alias("n_neighbours"))
            .withColumn("is_core", F.col("n_neighbours") >= min_pts))


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = DBSCAN_EPS, min_pts: int = DBSCAN_MIN_PTS,
           key: str = ID, grid_m: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, cluster, is_core, n_neighbours): cluster 0 is noise."""
    ship_package(df.sparkSession)
    cols = list(cols)
    eps2 = eps * eps
    dims = grid_dims(df, cols, eps, grid_m)
    groups = block_groups(df, cols, eps, dims, key, block_rows)
    counts = (groups.groupBy("_g").applyInPandas(_neighbour_counts(cols, key, eps2), f"{key} bigint, n bigint")
              .groupBy(key).agg(F.sum("n").alias("n_neighbours")))
    core = cut_lineage(counts.withColumn("is_core", F.col("n_neighbours") >= min_pts))

    flagged = groups.join(core.select(key, F.col("is_core").alias("core")), key)
    edges = flagged.groupBy("_g").applyInPandas(_core_forest(cols, key, eps2), "src bigint, dst bigint").distinct()
    comps = connected_components(edges, core.where("is_core").select(key), node=key)

    with_comp = (flagged.join(comps.select(F.col("id").alias(key), "comp"), key, "left")
                 .withColumn("comp", F.coalesce("comp", F.lit(int(NO_COMPONENT)))))    # a NULL would turn ids to floats
    border = (with_comp.groupBy("_g").applyInPandas(_border_labels(cols, key, eps2), f"{key} bigint, comp bigint")
              .groupBy(key).agg(F.min("comp").alias("bcomp")))
    numbers = running_total(comps.select("comp").distinct().withColumn("_one", F.lit(1)),
                            [], ["comp"], "_one", out="cluster").select("comp", F.col("cluster").cast("bigint"))
    out = (core.join(comps.select(F.col("id").alias(key), "comp"), key, "left")
           .join(border, key, "left")
           .withColumn("comp", F.coalesce("comp", "bcomp"))
           .join(numbers, "comp", "left")
           .select(key, F.coalesce("cluster", F.lit(0)).cast("bigint").alias("cluster"), "is_core",
                   F.col("n_neighbours").cast("bigint").alias("n_neighbours")))
    return out


# --- k-nearest-neighbour distance ----------------------------------------

def _knn_partial(cols, key, k):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
        if q.empty or r.empty:
            return pd.DataFrame({key: pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64")})
        qid, rid = q[key].to_numpy(), r[key].to_numpy()
        part = np.full((len(q), k), np.inf)
        for s, t, d2 in _tiles(q[cols].to_numpy(float), r[cols].to_numpy(float)):
            d2 = np.where(qid[s, None] == rid[None, t], np.inf, d2)
            part[s] = np.partition(np.hstack([part[s], d2]), k - 1, axis=1)[:, :k]
        part.sort(axis=1)
        ids = np.repeat(q[key].to_numpy(), part.shape[1])
        vals = np.sqrt(part.reshape(-1))
        ok = np.isfinite(vals)
        return pd.DataFrame({key: ids[ok], "d": vals[ok]})
    return fn


def knn_distance(df: DataFrame, cols: Sequence[str], k: int = DBSCAN_MIN_PTS, key: str = ID,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, knn_dist): distance to the k-th nearest other row.

    All block pairs (the radius is unknown in advance, so the distance work
    is quadratic); a row is copied 2 x blocks times, and each group keeps its
    k smallest distances per row.
    """
    ship_package(df.sparkSession)
    cols = list(cols)
    blocks = block_count(df.sparkSession, df.count(), block_rows)
    base = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    blk = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = base.select("*", blk.alias("_q"), every.alias("_r"), F.lit(0).alias("_role"))
    r = base.select("*", every.alias("_q"), blk.alias("_r"), F.lit(1).alias("_role"))
    part = q.unionByName(r).withColumn("_g", F.struct("_q", "_r")).drop("_q", "_r").groupBy("_g").applyInPandas(_knn_partial(cols, key, k), f"{key} bigint, d double")
    w = Window.partitionBy(key).orderBy("d")
    # per row at most k x blocks candidates: a bounded window group.
    return (part.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == k)
            .select(key, F.col("d").alias("knn_dist")))


def dbscan_summary(labels: DataFrame) -> DataFrame:
    """(cluster, border, seed, total): seed = core rows; noise rows are cluster 0."""
    return (labels.groupBy("cluster")
            .agg(F.count_if(~F.col("is_core")).cast("bigint").alias("border"),
                 F.count_if(F.col("is_core")).cast("bigint").alias("seed"),
                 F.count(F.lit(1)).cast("bigint").alias("total")))
