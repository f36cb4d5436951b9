"""Starts for mixtures by model-based agglomeration over micro-clusters.

The rows are first gathered into up to ``MICRO`` micro-clusters (K-means, one
start); one pass gives each its sufficient statistics: rows n, sum, and scatter
W around its mean. The tree then merges, again and again, the two clusters
whose union raises

    sum over clusters of  n log det(W / n + ridge I)

least: the classification likelihood of a mixture with a covariance of its own
for each cluster. The ridge, a hundredth of the mean variance, stands in for
clusters with too few rows for a covariance. Merging adds statistics
(n, sum, and W plus the scatter between the two means), so the tree needs no
row; it works on at most ``MICRO`` d x d matrices on the driver, whatever the
table's size. A start with g groups is the partition with g clusters left.

Defined results: with fewer rows than micro-clusters each row may be one; equal
increases merge the pair with the smallest numbers; more groups than
micro-clusters give as many groups as there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cohortlens.operators import kmeans_many as kk
from cohortlens.schema import ID

MICRO = 100
RIDGE = 0.01


@dataclass(frozen=True)
class Partition:
    """Rows go to the nearest of ``centres`` (micro-clusters x d) and with it to ``group``; ``means`` are the groups' means."""

    centres: np.ndarray
    group: np.ndarray
    means: np.ndarray


def union(a: tuple, b: tuple) -> tuple:
    """(n, mean, W) of two clusters together."""
    n = a[0] + b[0]
    off = a[1] - b[1]
    return n, (a[0] * a[1] + b[0] * b[1]) / n, a[2] + b[2] + (a[0] * b[0] / n) * np.outer(off, off)


def spread(n: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """n log det(W / n + ridge I) for stacked statistics."""
    d = w.shape[-1]
    return n * np.linalg.slogdet(w / n[..., None, None] + ridge * np.eye(d))[1]


def merge_order(n: np.ndarray, mean: np.ndarray, w: np.ndarray, ridge: float | None = None) -> list[tuple[int, int]]:
    """The merges (i, j), i < j, in order; the union goes on as i."""
    m, d = mean.shape
    if ridge is None:
        total = (n[:, None] * mean).sum(axis=0) / n.sum()
        off = mean - total
        ridge = RIDGE * (np.trace(w.sum(axis=0)) + (n * (off * off).sum(axis=1)).sum()) / (n.sum() * d) or 1.0
    n, mean, w = n.astype(float).copy(), mean.copy(), w.copy()
    own = spread(n, w, ridge)
    alive = np.ones(m, bool)
    rise = np.full((m, m), np.inf)

    def refresh(i: int, others: np.ndarray) -> None:
        total = n[i] + n[others]
        off = mean[i] - mean[others]
        both = w[i] + w[others] + (n[i] * n[others] / total)[:, None, None] * off[:, :, None] * off[:, None, :]
        r = spread(total, both, ridge) - own[i] - own[others]
        lo, hi = np.minimum(i, others), np.maximum(i, others)
        rise[lo, hi] = r

    for i in range(m):
        refresh(i, np.arange(i + 1, m))
    out = []
    for _ in range(m - 1):
        i, j = np.unravel_index(np.argmin(rise), rise.shape)
        i, j = int(i), int(j)
        out.append((i, j))
        n[i], mean[i], w[i] = union((n[i], mean[i], w[i]), (n[j], mean[j], w[j]))
        own[i] = spread(n[i:i + 1], w[i:i + 1], ridge)[0]
        alive[j] = False
        rise[j, :], rise[:, j] = np.inf, np.inf
        rest = np.flatnonzero(alive)
        refresh(i, rest[rest != i])
    return out


def groups_left(m: int, merges: list[tuple[int, int]], g: int) -> np.ndarray:
    """Group number (0..) of each micro-cluster when ``g`` clusters are left, in the order of their smallest members."""
    root = np.arange(m)
    for i, j in merges[:max(0, m - g)]:
        root[root == j] = i
    return np.unique(root, return_inverse=True)[1].reshape(-1)


def partitions(df: DataFrame, cols: Sequence[str], groups: Sequence[int], micro: int = MICRO, seed: int = 123, key: str = ID
               ) -> dict[int, Partition]:
    """g -> the partition with g groups, for every g of ``groups``, all from one tree."""
    from cohortlens.operators import mixture as mx
    cols = list(cols)
    rows = df.select(key).limit(micro).count()
    centres = kk.fit_many(df, cols, {max(1, min(micro, rows)): (1, 20)}, seed, key).runs[0].centres
    n, _, sums, w = mx._pass(df, cols, {0: ("hard", centres)})[0]
    have = n > 0
    centres, n, w = centres[have], n[have], w[have]
    mean = sums[have] / n[:, None]
    off = mean - centres                                 # scatter came around the centres
    w = w - n[:, None, None] * off[:, :, None] * off[:, None, :]
    merges = merge_order(n, mean, w)
    out = {}
    for g in groups:
        group = groups_left(len(n), merges, g)
        size = np.bincount(group, n)
        means = np.stack([np.bincount(group, n * mean[:, j]) for j in range(len(cols))], axis=1) / size[:, None]
        out[g] = Partition(centres, group, means)
    return out
