"""Embedding near-dedup: cross-polytope hashing with multiprobe and verified pairs.

A hash of a unit vector is the coordinate of largest magnitude, with its sign,
after three rounds of random signs and a fast Hadamard transform. A bucket
code joins ``k`` such hashes; every vector goes into its own bucket and into
those where one of the hashes is replaced by its second or third choice. Pairs
that share a bucket in any of the tables are verified by their cosine in
double precision.

``k`` follows the number of vectors (so that chance meetings per vector stay
few) and the number of tables follows ``k``: it is set by simulating pairs at
exactly the threshold, so that a link is missed with probability ``miss`` at
most; closer pairs are missed far less often.

Equal vectors are one class with a multiplicity. Tight groups are settled
without looking at their pairs: a vector within half the threshold's angle of
the first member of one of its own buckets joins that member's clique, and any
two of a clique are linked by the triangle inequality. Only pairs across
cliques are verified one by one. Buckets are cut into blocks of bounded size
and every pair of blocks is compared on its own; a task emits per vector one
sum of links and one edge of a spanning forest, never pairs. A pair that meets
in several buckets is counted in the smallest common code only.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length do not link;
repeated rows are equal vectors and link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import U64, mix, stage, start
from cohortlens.llm.components import connected_components

BLOCK = 1024            # vectors of a bucket that meet in one task
CHANCE = 16.0           # expected chance partners of a vector in one table
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d = x.shape
    x, h = x.copy(), 1
    while h < d:
        v = x.reshape(n, d // (2 * h), 2, h)
        a, b = v[:, :, 0, :].copy(), v[:, :, 1, :]
        v[:, :, 0, :] += b
        v[:, :, 1, :] = a - b
        h *= 2
    return x / math.sqrt(d)


def choices(x: np.ndarray, seed: int, index: int) -> np.ndarray:
    """The three best cross-polytope vertices of each row under rotation ``index``: (rows, 3)."""
    rng = np.random.default_rng([seed, index, x.shape[1]])
    for _ in range(ROUNDS):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    a = np.abs(x)
    top = min(3, x.shape[1])
    order = np.argsort(-a, axis=1, kind="stable")[:, :top]
    out = 2 * order + (np.take_along_axis(x, order, 1) > 0)
    return np.pad(out, ((0, 0), (0, 3 - top)), mode="edge").astype(np.uint64)


def codes(x: np.ndarray, dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes of unit rows: all, sorted (rows, tables * (1 + 2 k)), and the own ones (rows, tables).

    A code belongs to one table."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    out = []
    for t in range(tables):
        c = [choices(x, seed, t * k + i) for i in range(k)]
        probes = [[ci[:, 0] for ci in c]]
        for i in range(k):
            for r in (1, 2):
                probes.append([ci[:, r] if j == i else ci[:, 0] for j, ci in enumerate(c)])
        for p in probes:
            code = np.full(len(x), mix(np.array([t + 1 + (dim << 20)], np.uint64))[0])
            for v in p:
                code = mix(code * U64(0x9E3779B97F4A7C15) + v)
            out.append(code.view(np.int64))
    every = np.stack(out, axis=1)
    return np.sort(every, axis=1), every[:, :: 1 + 2 * k].copy()


def plan(n: int, dim: int, threshold: float, miss: float) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors; the tables by simulated pairs at the threshold."""
    d = 1 << max(1, (dim - 1).bit_length())
    k = 1
    while n * (1 + 2 * k) ** 2 / (2.0 * d) ** k > CHANCE:
        k += 1
    rng = np.random.default_rng(12345)
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * z
    a, b = codes(x, dim, k, 1, 99)[0], codes(y, dim, k, 1, 99)[0]
    met = np.zeros(len(a), bool)
    for i in range(a.shape[1]):
        met |= (b == a[:, i: i + 1]).any(1)
    p = min(max(float(met.mean()) - 0.01, 0.01), 0.999)
    return k, max(2, math.ceil(math.log(miss) / math.log(1 - p)))


def unit_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as doubles) of equally long list values."""
    n = len(col)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)          # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
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


def _compare(code: int, side: np.ndarray, off_diagonal: bool, x: np.ndarray, every: np.ndarray, weight: np.ndarray,
             clique: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links per row, smallest reachable row) across cliques, within one pair of blocks of one bucket."""
    n = len(weight)
    links, ii, jj = np.zeros(n, np.int64), [], []
    names, number = np.unique(clique, return_inverse=True)
    if len(names) == 1:
        return links, np.arange(n)
    largest = np.argmax(np.bincount(number))
    some = np.flatnonzero(number != largest)               # the largest clique has no pairs of its own
    for s in range(0, len(some), 512):
        rows = some[s: s + 512]
        i, j = np.nonzero(x[rows] @ x.T >= threshold - 1e-9)
        i = rows[i]
        ok = (number[i] != number[j]) & ((i < j) | (number[j] == largest))
        if off_diagonal:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        for at in range(0, len(i), 20_000):
            a, b = i[at: at + 20_000], j[at: at + 20_000]
            smaller = np.zeros(len(a), bool)               # both hold a smaller code: counted there
            for c in range(every.shape[1]):
                live = np.flatnonzero(~smaller & (every[a, c] < code))
                if not len(live):
                    break
                smaller[live] = (every[b[live]] == every[a[live], c][:, None]).any(1)
            np.add.at(links, a[~smaller], weight[b[~smaller]])
            np.add.at(links, b[~smaller], weight[a[~smaller]])
        ii.append(i)
        jj.append(j)
    return links, forest(n, np.concatenate(ii), np.concatenate(jj))


def cliques(classes: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """(cid, clique) for the classes that join the clique of a bucket's first member."""
    close = math.cos(math.acos(threshold) / 2) + 1e-9      # half the angle, on the safe side
    own = coded.select("cid", F.explode(F.array_distinct("own")).alias("code"))
    first = own.groupBy("code").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pair = own.join(first.select("code", "lead"), "code").where("cid != lead").select("cid", "lead").distinct()
    vec = classes.select("cid", "embedding")
    both = pair.join(vec, "cid").join(vec.select(F.col("cid").alias("lead"), F.col("embedding").alias("other")), "lead")

    def check(batches):
        for batch in batches:
            n = batch.num_rows
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ok = np.zeros(n, bool)
            for dim in np.unique(dims).tolist():           # a bucket holds one length only
                sel = np.flatnonzero(dims == dim)
                a, b = (unit_rows(batch.column(c).take(pa.array(sel))) for c in (2, 3))
                ok[sel] = np.einsum("ij,ij->i", a, b) >= close
            yield batch.select([0, 1]).filter(pa.array(ok))

    return (both.select("cid", "lead", "embedding", "other").mapInArrow(check, "cid long, lead long")
            .groupBy("cid").agg(F.min("lead").alias("clique")))


def class_links(classes: DataFrame, threshold: float, k: int, tables: int, seed: int) -> DataFrame:
    """(cid, root, links): partial sums of links and forest edges from every bucket block."""
    spark = start(classes)
    width = tables * (1 + 2 * k)

    def hashed(batches):
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 2000):
                    p = part.slice(s, 2000)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()),
                                                      pa.array(c.ravel()))
                             for c in codes(unit_rows(p.column(1)), dim, k, tables, seed)]
                    yield pa.RecordBatch.from_arrays([p.column(0), *lists], names=["cid", "codes", "own"])

    coded = stage(classes.select("cid", "embedding").mapInArrow(hashed, "cid long, codes array<long>, own array<long>"),
                  "cp-codes")
    found = cliques(classes, coded, threshold)
    classes = stage(classes.join(found, "cid", "left").withColumn("clique", F.coalesce("clique", "cid")), "cp-cliques")
    rows = (coded.join(classes.select("cid", "clique"), "cid")
            .select("cid", "clique", F.explode(F.array_distinct("codes")).alias("code")))
    # a bucket of one clique has nothing to compare
    buckets = (rows.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("clique").alias("a"), F.max("clique").alias("b"))
               .where("a != b").select("code", F.ceil(F.col("m") / BLOCK).alias("nb")))
    # each member goes to the pairs of blocks that hold its own block
    member = (rows.drop("clique").join(buckets, "code")
              .withColumn("blk", F.pmod(F.xxhash64("cid", "code"), F.col("nb")))
              .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
              .select("cid", "code", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk"))
    full = member.join(classes.select("cid", "embedding", "n", "clique").join(coded.select("cid", "codes"), "cid"), "cid")
    full = full.repartition(F.col("code"), F.col("bi"), F.col("bj")).sortWithinPartitions("code", "bi", "bj", "cid")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("code", "bi", "bj")], 1)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            cid, blk, w, cl = (t.column(c).to_numpy() for c in ("cid", "blk", "n", "clique"))
            dims = t.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            every = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cid), width)
            size = np.diff(np.append(cut, len(cid)))
            out = [np.zeros(0, np.int64)] * 3
            outs = []
            for dim in np.unique(dims).tolist():           # a bucket holds one length only
                x = np.zeros((len(cid), dim))
                sel = np.flatnonzero(dims == dim)
                x[sel] = unit_rows(t.column("embedding").combine_chunks().take(pa.array(sel)))
                for s, m in zip(cut.tolist(), size.tolist()):
                    if m < 2 or dims[s] != dim:
                        continue
                    e = s + m
                    links, lab = _compare(key[s, 0], blk[s:e], key[s, 1] != key[s, 2], x[s:e], every[s:e], w[s:e],
                                          cl[s:e], threshold)
                    some = np.flatnonzero((links > 0) | (lab != np.arange(m)))
                    if len(some):
                        outs.append((cid[s:e][some], cid[s:e][lab[some]], links[some]))
            if outs:
                out = [np.concatenate(c) for c in zip(*outs)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["cid", "root", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("code", "bi", "bj")]
            same = np.all([c == c[-1] for c in key], axis=0)   # rows of the last group, still open
            tail = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and tail == 0:
                prev = [held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in ("code", "bi", "bj")]
                if prev != [int(c[0]) for c in key]:
                    yield flush()
                    held.clear()
                held.append(batch)
                continue
            held.append(batch.slice(0, tail))
            if tail:
                yield flush()
                held.clear()
            held.append(batch.slice(tail))
        if held:
            yield flush()

    across = full.select("cid", "code", "bi", "bj", "blk", "embedding", "n", "codes", "clique").mapInArrow(
        compare, "cid long, root long, links long")
    size = classes.groupBy("clique").agg(F.sum("n").alias("all"))
    within = classes.join(size, "clique").select("cid", F.col("clique").alias("root"), (F.col("all") - F.col("n")).alias("links"))
    return across.unionByName(within)


def embedding_components(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-4, seed: int = 7,
                         id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    v = F.col("embedding")
    good = (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
            & F.exists(v, lambda e: e != 0))
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    src = src.withColumn("good", F.coalesce(good, F.lit(False)))
    # equal vectors: two independent hashes of the components
    src = src.withColumn("h1", F.when(F.col("good"), F.xxhash64("embedding"))) \
             .withColumn("h2", F.when(F.col("good"), F.hash("embedding", F.lit(1))))
    classes = stage(src.where("good").groupBy("h1", "h2")
                    .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
                    .withColumn("cid", F.monotonically_increasing_id()), "cp-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    k, tables = plan(n, dim or 1, threshold, miss)
    part = stage(class_links(classes, threshold, k, tables, seed), "cp-links")
    comp = connected_components(part.where("cid != root").select("cid", "root"))
    direct = part.groupBy("cid").agg(F.sum("links").alias("links"))
    label = classes.select("cid", "first").join(comp.withColumnRenamed("node", "cid"), "cid")
    label = label.join(label.groupBy("root").agg(F.min("first").alias("smallest")), "root").select("cid", "smallest")
    result = stage(classes.join(direct, "cid", "left").join(label, "cid", "left")
                   .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("smallest", "first").alias("component_id")), "cp-result")
    out = src.drop("embedding").join(result, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
