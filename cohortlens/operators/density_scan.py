"""DBSCAN, labels for new rows and k-nearest-neighbour distances over bounded leaves.

``dbscan_leaves`` gives the labels of ``dbscan.dbscan`` without counting every
neighbour:

1. Rows go to leaves (``leaves.grow``). Inside a leaf a hash grid over all
   measures with cells of eps / sqrt(d) collapses dense places: the rows of a
   cell with ``min_pts`` rows or more are core and connected, with no distance
   taken. Any other row counts piece by piece, near ones first, and stops at ``min_pts``.
2. Only rows still short of ``min_pts`` visit other leaves within eps.
3. A spanning forest of each leaf's core rows, cells first; two tiles that
   are connected already are skipped, of others only rows outside the common
   component are compared.
4. Parts of one cluster in different leaves are joined in two steps. Each part
   sends ``ENVOYS`` rows to the ``NEAREST`` near leaves, which ties nearly all. What is left is
   exact: a row visits a near leaf only for parts of *another* component there,
   and the smaller component's rows go to the larger one. So rows of the large
   clusters stay where they are, whatever the size of the table.
5. Rows that are not core visit near leaves for the lowest cluster number.

``work`` tells the row copies and distances of every step.

Defined results: rows with a null or NaN measure are noise (cluster 0); the
cluster number is the rank of its smallest core id; MinPts counts the row
itself; a distance of exactly eps is near; an empty table has no labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators import leaves as lv
from cohortlens.operators import pairs
from cohortlens.operators.dbscan import TILE, _forest
from cohortlens.operators.prefix import running_total
from cohortlens.schema import DBSCAN_EPS, DBSCAN_MIN_PTS, ID
from cohortlens.session import write_stage

ENVOYS = 32                 # rows that a leaf's part of a component sends first
NEAREST = 4                 # leaves that they are sent to
NO_LABEL = np.iinfo(np.int64).max


def cells_of(x: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each row, rows of each cell): any two rows of a cell are within eps."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = eps / np.sqrt(x.shape[1]) * (1 - 1e-9)
    _, cell, n = np.unique(np.floor(x / side), axis=0, return_inverse=True, return_counts=True)
    return cell.reshape(-1), n


def count_to(x: np.ndarray, ref: np.ndarray, eps: float, enough: int | None) -> tuple[np.ndarray, int]:
    """(rows of ``ref`` within eps, exact below ``enough``; distances taken)."""
    return pairs.count_within(x, pairs.Blocks(ref), eps * eps, enough)


def forest_of(x: np.ndarray, eps: float, min_pts: int) -> tuple[np.ndarray, int]:
    """(component number of each core row, distances taken) within one leaf."""
    cell, size = cells_of(x, eps)
    order = np.argsort(cell, kind="stable")
    first = order[np.searchsorted(cell[order], np.arange(len(size)))]
    # rows of a cell hang on its first row, however many they are: all are core and within eps
    root, taken, eps2 = first[cell], 0, eps * eps
    tiles = [order[i:i + TILE] for i in range(0, len(order), TILE)]
    for gap in range(len(tiles)):
        for i in range(len(tiles) - gap):
            a, b = tiles[i], tiles[i + gap]
            ra, rb = root[a], root[b]
            roots, n = np.unique(np.concatenate([ra, rb]), return_counts=True)
            if len(roots) == 1:
                continue
            common = roots[n.argmax()]
            found = []
            for p, q in ((a[ra != common], b), (a[ra == common], b[rb != common])):
                if len(p) and len(q):
                    taken += len(p) * len(q)
                    k, m = pairs.found(pairs.within(x[p], x[q], eps2) & (root[p][:, None] != root[q][None, :]))
                    found.append((p[k], q[m]))
            k, m = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int),) * 2
            if len(k):
                every = np.arange(len(x))
                root = _forest(len(x), np.concatenate([every, k]), np.concatenate([root, m]))
    return root, taken


def _own_counts(cols, key, eps, min_pts):
    def fn(_, table):
        x = lv.measures(table, cols)
        cell, size = cells_of(x, eps)
        n = size[cell]
        short = np.flatnonzero(n < min_pts)
        n[short], taken = count_to(x[short], x, eps, min_pts)
        cost = np.zeros(len(n), np.int64)
        cost[:1] = taken
        return table.append_column("n", pa.array(n)).append_column("pairs", pa.array(cost))
    return fn


def _own_forest(cols, key, eps, min_pts):
    def fn(_, table):
        x, ids = lv.measures(table, cols), table.column(key).to_numpy()
        root, taken = forest_of(x, eps, min_pts)
        _, part = np.unique(root, return_inverse=True)
        comp = np.full(part.max() + 1, NO_LABEL)
        np.minimum.at(comp, part, ids)
        # the envoys: rows spread over each part
        order = np.argsort(part, kind="stable")
        size = np.bincount(part)
        nth = np.empty(len(part), np.int64)
        nth[order] = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        envoy = nth % np.maximum(1, -(-size // ENVOYS))[part] == 0
        cost = np.zeros(len(ids), np.int64)
        cost[:1] = taken
        return (table.append_column("comp", pa.array(comp[part])).append_column("envoy", pa.array(envoy))
                .append_column("pairs", pa.array(cost)))
    return fn


def _counts_of_guests(cols, key, eps, min_pts):
    def fn(own, come):
        n, taken = count_to(lv.measures(come, cols), lv.measures(own, cols), eps, min_pts)
        cost = np.zeros(len(n), np.int64)
        cost[:1] = taken
        return pa.table({key: come.column(key), "n": n, "pairs": cost})
    return fn


def _links_of_guests(cols, eps):
    """Distinct links (component of the guest, component here) between rows of different ``whole``."""
    def fn(own, come):
        x, y = lv.measures(come, cols), lv.measures(own, cols)
        here, mine = own.column("comp").to_numpy(), come.column("comp").to_numpy()
        whole, theirs = own.column("whole").to_numpy(), come.column("whole").to_numpy()
        found, taken, eps2 = {}, 0, eps * eps
        for s in range(0, len(x), TILE):
            for t in range(0, len(y), TILE):
                # components that are tied already are passed over
                other = whole[t:t + TILE][None, :] != theirs[s:s + TILE][:, None]
                if not other.any():
                    continue
                taken += other.size
                i, j = pairs.found(other & pairs.within(x[s:s + TILE], y[t:t + TILE], eps2))
                found |= dict.fromkeys(zip(mine[s + i].tolist(), here[t + j].tolist()))
        src, dst = zip(*found) if found else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()),
                         "pairs": pa.array([taken] + [0] * (len(found) - 1) if found else [], pa.int64())})
    return fn


def _lowest_of_guests(cols, key, eps):
    def fn(own, come):
        x, y = lv.measures(come, cols), lv.measures(own, cols)
        label, best = own.column("cluster").to_numpy(), np.full(len(x), NO_LABEL)
        for s in range(0, len(x), TILE):
            for t in range(0, len(y), TILE):
                near = pairs.within(x[s:s + TILE], y[t:t + TILE], eps * eps)
                best[s:s + TILE] = np.minimum(best[s:s + TILE], np.where(near, label[None, t:t + TILE], NO_LABEL).min(axis=1))
        ok = best < NO_LABEL
        return pa.table({key: come.column(key).filter(pa.array(ok)), "cluster": best[ok]})
    return fn


@dataclass
class DensityFit:
    """Labels of the fitted rows, and what is needed to label others.

    ``cores``: (key, measures, leaf, cluster) of the core rows; ``steps``: (step, rows sent, their distances).
    """

    tree: lv.Leaves
    cores: DataFrame
    labels: DataFrame
    eps: float
    steps: list[tuple[str, DataFrame, DataFrame | None]] = field(default_factory=list)

    @property
    def work(self) -> list[tuple[str, int, int]]:
        """(step, row copies, distances) of every step."""
        return [(step, sent.count(), int((taken.agg(F.sum("pairs")).first()[0] if taken else 0) or 0))
                for step, sent, taken in self.steps]


def _tied(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(comp, whole): the smallest node that each node reaches along ``links`` (src, dst).

    The links are far fewer than the rows: one for each pair of parts in near
    leaves. Labels only fall, so a round that leaves their sum has changed none.
    """
    both = write_stage(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                       .distinct(), "scan-edges")
    label, before = nodes.select("comp", F.col("comp").alias("whole")), None
    while True:
        low = (both.join(label.select(F.col("comp").alias("dst"), "whole"), "dst").groupBy(F.col("src").alias("comp"))
               .agg(F.min("whole").alias("low")))
        step = label.join(low, "comp", "left").select("comp", F.least("whole", F.coalesce("low", "whole")).alias("whole"))
        # and on to the label of the label
        label = write_stage(step.join(step.select(F.col("comp").alias("whole"), F.col("whole").alias("next")), "whole", "left")
                            .select("comp", F.least("whole", F.coalesce("next", "whole")).alias("whole")), "scan-tied")
        total = label.agg(F.sum(F.col("whole").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return label
        before = total


def _guests(tree: lv.Leaves, rows: DataFrame, eps: float, own: bool, most: int | None = None) -> DataFrame:
    """The rows, once for each leaf whose box is within eps of them (``own``: their own leaf, too).

    ``most``: only to so many leaves, those whose centres are nearest to the centre of the rows' leaf.
    """
    cols = tree.cols
    asks = rows.groupBy("leaf").agg(F.lit(float(eps)).alias("r"))
    visits = lv.near_leaves(tree, asks)
    visits = visits if own else visits.where("leaf != to")
    if most:
        nth = F.row_number().over(Window.partitionBy("leaf").orderBy("centres", "to"))
        visits = visits.withColumn("nth", nth).where(F.col("nth") <= most)
    return (rows.join(visits, "leaf").where(lv.row_to_box(cols) <= eps * eps * (1 + 1e-9))
            .select(*rows.columns, "to"))


def dbscan_leaves(df: DataFrame, cols: Sequence[str], eps: float = DBSCAN_EPS, min_pts: int = DBSCAN_MIN_PTS,
                  key: str = ID, leaf_rows: int | None = None, tree: lv.Leaves | None = None) -> DensityFit:
    """Fit DBSCAN; ``labels`` of the result: (key, measures, cluster, is_core) for every row of ``df``.

    ``tree``: the leaves of ``df`` if they stand already.
    """
    cols = list(cols)
    tree = tree or lv.grow(df, cols, key, leaf_rows)
    rows, near = tree.rows, eps * eps * (1 + 1e-9)
    values = f"{key} bigint, " + ", ".join(f"{c} double" for c in cols) + ", leaf bigint"

    # 1, 2: core rows
    own = write_stage(lv.dealt(rows, "leaf").groupBy("leaf").applyInArrow(_own_counts(cols, key, eps, min_pts), f"{values}, n bigint, pairs bigint"),
                      "scan-own")
    short = own.where(F.col("n") < min_pts)
    far = write_stage(_guests(tree, short.select(key, *cols, "leaf"), eps, own=False), "scan-guests")
    more = write_stage(lv.visit(rows, far, _counts_of_guests(cols, key, eps, min_pts), f"{key} bigint, n bigint, pairs bigint",
                                key), "scan-more")
    late = short.join(more.groupBy(key).agg(F.sum("n").alias("extra")), key, "left").select(
        key, *cols, "leaf", (F.col("n") + F.coalesce("extra", F.lit(0)) >= min_pts).alias("is_core"))
    flagged = write_stage(own.where(F.col("n") >= min_pts).select(key, *cols, "leaf", F.lit(True).alias("is_core")).unionByName(late),
                          "scan-core")

    # 3: parts within the leaves
    parted = write_stage(lv.dealt(flagged.where("is_core").drop("is_core"), "leaf").groupBy("leaf").applyInArrow(
        _own_forest(cols, key, eps, min_pts), f"{values}, comp bigint, envoy boolean, pairs bigint"), "scan-parts")
    comps = write_stage(parted.groupBy("leaf", "comp").agg(F.count(F.lit(1)).alias("n"), *lv.box_of(cols)), "scan-comps")

    # 4: parts of different leaves
    links = "src bigint, dst bigint, pairs bigint"
    home = parted.select(key, *cols, "leaf", "comp", F.col("comp").alias("whole"))
    sent = write_stage(_guests(tree, home.join(parted.where("envoy").select(key), key, "left_semi"), eps, own=False, most=NEAREST),
                       "scan-envoys")
    first = write_stage(lv.visit(home, sent, _links_of_guests(cols, eps), links, key), "scan-links")
    nodes = comps.select("comp")
    tied = _tied(first, nodes)
    sized = comps.join(tied, "comp")
    mass = sized.groupBy("whole").agg(F.sum("n").alias("mass"))
    sized = write_stage(sized.drop("n").join(mass, "whole"), "scan-sized")
    boxes = lv.box_columns(cols)
    asks = sized.groupBy("leaf").agg(F.lit(float(eps)).alias("r"))
    there = sized.select(F.col("leaf").alias("to"), F.col("whole").alias("other"), F.col("mass").alias("more"), *boxes)
    open_ = (sized.select("leaf", "comp", "whole", "mass", *[F.col(c).alias(f"q_{c}") for c in boxes])
             .join(lv.near_leaves(tree, asks).select("leaf", "to").where("leaf != to"), "leaf").join(there, "to")
             .where((F.col("whole") != F.col("other"))
                    & ((F.col("mass") < F.col("more")) | ((F.col("mass") == F.col("more")) & (F.col("whole") < F.col("other"))))
                    & (lv.box_to_box(cols, "q_", "") <= near))
             .select("comp", "whole", "to", *boxes))
    rest = write_stage(parted.select(key, *cols, "comp").join(open_, "comp").where(lv.row_to_box(cols) <= near)
                       .select(key, *cols, "comp", "whole", "to").distinct(), "scan-rest")
    home = parted.select(key, *cols, "leaf", "comp").join(tied, "comp")
    second = write_stage(lv.visit(home, rest, _links_of_guests(cols, eps), links, key), "scan-links")
    # without further links the parts are tied as they were
    ends = tied if second.limit(1).count() == 0 else _tied(first.unionByName(second), nodes)
    numbers = running_total(ends.select("whole").distinct().withColumn("_one", F.lit(1)), [], ["whole"], "_one", out="cluster")
    numbers = ends.join(numbers, "whole").select("comp", F.col("cluster").cast("bigint").alias("cluster"))
    labelled = write_stage(parted.join(numbers, "comp").select(key, *cols, "leaf", "cluster"), "scan-cores")

    # 5: border rows and noise
    fit = DensityFit(tree, labelled, labelled, eps, [
        ("neighbours in the own leaf", own, own), ("neighbours in other leaves", far, more), ("forest in the own leaf", parted, parted),
        ("envoys", sent, first), ("parts not yet tied", rest, second)])
    lone = flagged.where(~F.col("is_core")).select(key, *cols, "leaf")
    edge = _reached(fit, lone)
    # the measures stand beside the labels, so nobody has to join them back
    no, none = F.lit(False).alias("is_core"), F.lit(0).cast("bigint").alias("cluster")
    out = (labelled.select(key, *cols, "cluster", F.lit(True).alias("is_core"))
           .unionByName(lone.join(edge, key, "left").select(key, *cols, F.coalesce("cluster", F.lit(0)).cast("bigint").alias("cluster"), no))
           .unionByName(df.where(~lv.usable(cols)).select(key, *[F.col(c).cast("double").alias(c) for c in cols], none, no)))
    fit.labels = write_stage(out, "scan-labels")
    return fit


def _reached(fit: DensityFit, rows: DataFrame) -> DataFrame:
    """(key, lowest cluster with a core row within eps) for the rows that reach one."""
    tree = fit.tree
    sent = write_stage(_guests(tree, rows.select(tree.key, *tree.cols, "leaf"), fit.eps, own=True), "scan-guests")
    got = lv.visit(fit.cores, sent, _lowest_of_guests(tree.cols, tree.key, fit.eps), f"{tree.key} bigint, cluster bigint", tree.key)
    fit.steps.append(("border rows", sent, None))
    return got.groupBy(tree.key).agg(F.min("cluster").alias("cluster"))


def assign(fit: DensityFit, df: DataFrame) -> DataFrame:
    """(key, cluster) of rows that need not have been fitted: the lowest cluster with a core row within eps, else 0.

    New rows walk down the fitted tree's boxes from the root, so only near leaves are asked.
    """
    tree, eps2 = fit.tree, fit.eps * fit.eps * (1 + 1e-9)
    cols, key = tree.cols, tree.key
    cur = df.where(lv.usable(cols)).select(key, *[F.col(c).cast("double").alias(c) for c in cols],
                                           F.lit(0).cast("bigint").alias("to"))
    for level in tree.levels:
        nodes = level.select("node", F.col("parent").alias("to"), *lv.box_columns(cols))
        cur = (cur.join(nodes, "to").where(lv.row_to_box(cols) <= eps2)
               .select(key, *cols, F.col("node").alias("to")))
    got = lv.visit(fit.cores, write_stage(cur, "scan-guests"), _lowest_of_guests(cols, key, fit.eps),
                   f"{key} bigint, cluster bigint", key)
    best = got.groupBy(key).agg(F.min("cluster").alias("cluster"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("cluster", F.lit(0)).cast("bigint").alias("cluster"))


# --- k-nearest-neighbour distances ---------------------------------------

def _near_array(best: np.ndarray) -> pa.ListArray:
    ok = np.isfinite(best)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ok.sum(axis=1))), pa.int32()), pa.array(best[ok]))


def knn_leaves(df: DataFrame, cols: Sequence[str], k: int = DBSCAN_MIN_PTS, key: str = ID, leaf_rows: int | None = None,
               tree: lv.Leaves | None = None) -> DataFrame:
    """(key, knn_dist, visits): distance to the k-th nearest other row, and the leaves beyond its own that were asked.

    The k-th distance within a row's own leaf is a bound: only leaves whose box
    is nearer than it can hold a nearer row, and only those are visited. Rows
    without k others have no result; nor do rows with a null or NaN measure.
    """
    cols = list(cols)
    tree = tree or lv.grow(df, cols, key, leaf_rows)
    rows = tree.rows

    def own(_, table):
        x, ids = lv.measures(table, cols), table.column(key).to_numpy()
        best = pairs.k_nearest(x, ids, pairs.Blocks(x), ids, k)
        return table.append_column("near", _near_array(best)).append_column("bound", pa.array(best[:, -1]))

    schema = ", ".join(f"{c} double" for c in cols)
    known = write_stage(lv.dealt(rows.select(key, *cols, "leaf"), "leaf").groupBy("leaf").applyInArrow(
        own, f"{key} bigint, {schema}, leaf bigint, near array<double>, bound double"), "knn-own")
    reach = known.groupBy("leaf").agg(F.sqrt(F.max("bound")).alias("r"))
    guests = write_stage(known.drop("near").join(lv.near_leaves(tree, reach).where("leaf != to"), "leaf")
                         .where(lv.row_to_box(cols) < F.col("bound")).select(key, *cols, "bound", "to"), "knn-guests")

    def asked(own, come):
        best = pairs.k_nearest(lv.measures(come, cols), come.column(key).to_numpy(), pairs.Blocks(lv.measures(own, cols)),
                               own.column(key).to_numpy(), k, come.column("bound").to_numpy())
        return pa.table({key: come.column(key), "near": _near_array(best)})

    found = lv.visit(rows, guests, asked, f"{key} bigint, near array<double>", key)
    # k distances from each leaf that was asked
    every = known.select(key, "near", F.lit(0).alias("v")).unionByName(found.select(key, "near", F.lit(1).alias("v")))
    best = every.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"), F.sum("v").alias("visits"))
    return best.where(F.size("near") >= k).select(key, F.sqrt(F.get("near", F.lit(k - 1))).alias("knn_dist"), "visits")
