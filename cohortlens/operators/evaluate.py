"""Internal cluster-quality indices and model choice.

* silhouette: exact Euclidean silhouette over all pairs of the evaluated
  rows (the distance work is quadratic by definition).  Rows hash into g
  blocks; every two blocks meet once in a task of their own, which
  takes its distances tile by tile as matrix products (``pairs``) and adds them
  up for the rows of both blocks, by any number of labels.  A row is copied g
  times, with g the larger of the square root of 8 x cores and rows / ``BLOCK_ROWS``.
* Davies-Bouldin: centroids and spreads in one grouped aggregation; the
  k x k centroid comparison (k = number of clusters) is a join of centroid blocks.
* within-cluster sum of squares: join to the centroids (an aggregate of k
  rows, broadcast by AQE) and sum.
* adjusted Rand index: contingency counts by (a, b) and the usual sums of
  n(n-1)/2, all aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import sq_distance
from cohortlens.operators import kmeans as km
from cohortlens.operators import pairs
from cohortlens.schema import ID
from cohortlens.session import ship_package, write_stage

BLOCK_ROWS = 100_000        # rows of a block: what a task holds twice
SUM_CELLS = 20_000_000      # sums that a task holds: rows x clusters
CENTROID_BLOCK = 1000       # centroids that meet in one join key


def block_count(spark, n: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks per side: enough for all cores, and for blocks that fit a task."""
    return max(1, math.ceil(math.sqrt(spark.sparkContext.defaultParallelism)), math.ceil(n / block_rows))


def _pair_sums(cols, key, values):
    """Sums of distances of every row of two blocks to the clusters of the other, for all labels at once."""
    labels = list(values)
    offset = np.append(0, np.cumsum([len(v) for v in values.values()])).astype(int)

    def codes(table: pa.Table) -> np.ndarray:
        own = np.full((table.num_rows, len(labels)), -1, np.int64)
        for i, name in enumerate(labels):
            col = table.column(name)
            have = col.is_valid().to_numpy(zero_copy_only=False)
            own[have, i] = np.searchsorted(values[name], col.drop_null().to_numpy())
        return own

    def fn(table: pa.Table) -> pa.Table:
        lo, hi = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()
        own = codes(table)
        # rows of one combination of labels are added up together, and handed out to the clusters at the end
        combos, group = np.unique(own, axis=0, return_inverse=True)
        group = group.reshape(-1)
        cluster = np.zeros((len(combos), offset[-1]))
        for i in range(len(labels)):
            have = np.flatnonzero(combos[:, i] >= 0)
            cluster[have, offset[i] + combos[have, i]] = 1.0
        x = np.column_stack([table.column(c).fill_null(math.nan).to_numpy() for c in cols])
        block = table.column("_blk").to_numpy()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        sa, sb = pairs.group_sums(x[a], group[a], x[b], group[b], len(combos), lo == hi)
        at, sums = (a, sa @ cluster) if lo == hi else (np.concatenate([a, b]), np.concatenate([sa, sb]) @ cluster)
        n, width = sums.shape
        return pa.table({key: table.column(key).take(pa.array(at)),
                         "_own": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(labels), pa.int32()), pa.array(own[at].reshape(-1), pa.int32())),
                         "_sums": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(sums.reshape(-1)))})
    return fn


def meetings(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """The rows of ``df`` once for every two of ``blocks`` blocks (_lo, _hi) that they belong to; each _pair is a partition.

    The pair's number is the partition: cuts from a sample (``repartitionByRange``) can give one task several.
    """
    return (df.withColumn("_blk", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))
            .withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumns({"_lo": F.least("_blk", "_to"), "_hi": F.greatest("_blk", "_to")}).drop("_to")
            .withColumn("_pair", F.expr("int(_hi * (_hi + 1) / 2 + _lo)"))
            .repartitionById(blocks * (blocks + 1) // 2, "_pair"))


def label_widths(df: DataFrame, cols: Sequence[str], labels: Sequence[str], key: str = ID,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, {label}, a_{label}, b_{label}, s_{label}): silhouette widths by every label from one pass over the pairs.

    Every two blocks meet once, and their distances count for the rows of both.
    """
    spark = df.sparkSession
    ship_package(spark)
    cols, labels = list(cols), list(labels)
    base = write_stage(df.select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("bigint").alias(c) for c in labels],
                                 *[F.col(c).cast("double").alias(c) for c in cols]), "silhouette-rows")
    seen = base.groupBy(*labels).agg(F.count(F.lit(1)).alias("n")).collect()    # a row per combination of clusters
    sizes = [{} for _ in labels]
    for r in seen:
        for i, name in enumerate(labels):
            if r[name] is not None:
                sizes[i][r[name]] = sizes[i].get(r[name], 0) + r["n"]
    values = {name: np.array(sorted(sizes[i]), np.int64) for i, name in enumerate(labels)}
    size = [sizes[i][v] for i, name in enumerate(labels) for v in values[name].tolist()]
    # a task holds a sum for each of its rows and each combination or cluster
    rows = max(1, min(block_rows, SUM_CELLS // max(len(seen), len(size), 1)))
    blocks = max(math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)), math.ceil(sum(r["n"] for r in seen) / rows))
    sums = meetings(base, key, blocks).groupBy("_pair").applyInArrow(_pair_sums(cols, key, values),
                                                                    f"{key} bigint, _own array<int>, _sums array<double>")
    per = (sums.repartition(key).select(key, "_own", F.posexplode("_sums").alias("_at", "_d"))
           .groupBy(key, "_own", "_at").agg(F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("_n")))
    # each row came from every block once; rows of one key and label count together
    n_at = F.get(F.array(*[F.lit(int(v)) for v in size]).cast("array<bigint>"), F.col("_at")) * (F.col("_n") / blocks)
    aggs, out, first = [], [key], 0
    for i, name in enumerate(labels):
        last = first + len(values[name])
        here, mine = (F.col("_at") >= first) & (F.col("_at") < last), F.get("_own", F.lit(i))
        own = here & (F.col("_at") == mine + first)
        aggs += [F.max(F.when(own, n_at)).alias(f"_n{i}"), F.max(F.when(own, F.col("_d"))).alias(f"_s{i}"),
                 F.min(F.when(here & ~own & (mine >= 0), F.col("_d") / n_at)).alias(f"b_{name}")]
        n, b = F.col(f"_n{i}"), F.col(f"b_{name}")
        a = F.col(f"_s{i}") / (n - 1)
        s = (F.when(n <= 1, F.lit(0.0)).when(b.isNull(), F.lit(0.0))
             .otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))))
        value = F.when(mine >= 0, F.get(F.array(*[F.lit(int(v)).cast("bigint") for v in values[name]]), mine)) if last > first \
            else F.lit(None).cast("bigint")
        out += [value.alias(name), F.when(n > 1, a).alias(f"a_{name}"), b, s.alias(f"s_{name}")]
        first = last
    return per.groupBy(key, "_own").agg(*aggs).select(*out)


def silhouette_rows(df: DataFrame, cols: Sequence[str], label: str = "cluster", key: str = ID,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, label, a, b, s): silhouette width of every row (Euclidean).

    s = (b - a) / max(a, b); a row alone in its cluster gets 0.
    """
    return label_widths(df, cols, [label], key, block_rows).toDF(key, label, "a", "b", "s")


def silhouettes(df: DataFrame, cols: Sequence[str], labels: Sequence[str], key: str = ID) -> list[float | None]:
    """Mean silhouette width by each of ``labels``."""
    w = label_widths(df, cols, labels, key)
    return list(w.agg(*[F.avg(f"s_{name}") for name in labels]).first())


def silhouette(df, cols, label="cluster", key=ID) -> DataFrame:
    """One row: mean silhouette width."""
    return silhouette_rows(df, cols, label, key).agg(F.avg("s").alias("silhouette_score"))


def silhouette_by_cluster(df, cols, label="cluster", key=ID) -> DataFrame:
    return (silhouette_rows(df, cols, label, key).groupBy(label)
            .agg(F.count(F.lit(1)).alias("size"), F.avg("s").alias("avg_width")))


def centroids(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in cols])


def withinss(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """(cluster, size, withinss): sum of squared distances to the cluster mean."""
    cen = centroids(df, cols, label).select(label, *[F.col(c).alias(f"_c_{c}") for c in cols])
    # one row per cluster: AQE broadcasts it; rows stay where they are.
    j = df.join(cen, label)
    d2 = sq_distance([F.col(c) for c in cols], [F.col(f"_c_{c}") for c in cols])
    return j.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.sum(d2).alias("withinss"))


def wcss_labels(df, cols, label="cluster") -> DataFrame:
    return withinss(df, cols, label).agg(F.sum("withinss").alias("wcss"))


def wcss_refit(df, cols, k: int, seed: int = 123, nstart: int = 1, max_iter: int = 10) -> float:
    """Faithful variant: a fresh k-means with k = number of labels, its total withinss."""
    fit = km.sweep(df, cols, [k], nstart=nstart, max_iter=max_iter, seed=seed)
    return fit.best(k).cost


def davies_bouldin_value(df: DataFrame, cols: Sequence[str], label: str = "cluster",
                         drop_label: int | None = None) -> float | None:
    """Mean over clusters of max_j (S_i + S_j) / d(c_i, c_j), S = RMS distance to the centroid."""
    if drop_label is not None:
        df = df.where(F.col(label) != drop_label)
    cen = centroids(df, cols, label)
    spread = (df.join(cen.select(label, *[F.col(c).alias(f"_c_{c}") for c in cols]), label)
              .groupBy(label).agg(F.sqrt(F.avg(sq_distance([F.col(c) for c in cols],
                                                              [F.col(f"_c_{c}") for c in cols]))).alias("S")))
    c = write_stage(cen.join(spread, label).select(F.col(label).alias("_l"), F.col("S"), *cols), "centroids")
    # each cluster against every other one: a join on nothing but inequality would be a cross join, so
    # the clusters are dealt to blocks that meet block by block
    n = c.count()
    if n < 2:
        return None
    blocks = max(1, math.ceil(n / CENTROID_BLOCK))
    mine = c.withColumn("_b", F.pmod(F.xxhash64("_l"), F.lit(blocks)))
    a = mine.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = mine.select(F.col("_b").alias("_to"), F.col("_l").alias("_m"), F.col("S").alias("_s"), *[F.col(x).alias(f"_o_{x}") for x in cols])
    d = F.sqrt(sq_distance([F.col(x) for x in cols], [F.col(f"_o_{x}") for x in cols]))
    ratio = F.when(d > 0, (F.col("S") + F.col("_s")) / d).otherwise(F.lit(math.inf))
    worst = a.join(b, "_to").where("_l != _m").groupBy("_l").agg(F.max(ratio).alias("r"))
    return float(worst.agg(F.avg("r")).first()[0])


def davies_bouldin(df, cols, label="cluster", drop_label=None) -> DataFrame:
    v = davies_bouldin_value(df, cols, label, drop_label)
    return df.sparkSession.createDataFrame([(v,)], "db_index double")


def contingency(a: DataFrame, b: DataFrame, key: str = ID, la: str = "a", lb: str = "b") -> DataFrame:
    """(a, b, n) for two labelings joined by key."""
    j = a.select(key, F.col(la).alias("a")).join(b.select(key, F.col(lb).alias("b")), key)
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(a: DataFrame, b: DataFrame, key: str = ID, la: str = "a", lb: str = "b") -> DataFrame:
    """Adjusted Rand index of two labelings (1 when identical; 0/0 defined as 1)."""
    t = write_stage(contingency(a, b, key, la, lb), "contingency")
    c2 = lambda x: x * (x - 1) / 2.0
    # cells, row sums and column sums of the contingency table in one pass
    sums = t.rollup("a", "b").agg(F.sum("n").alias("m"), F.grouping_id().alias("g")).where("g < 3")
    cols_ = t.groupBy("b").agg(F.sum("n").alias("m")).withColumn("g", F.lit(2))
    parts = sums.select("m", F.col("g").cast("int").alias("g")).unionByName(cols_.select("m", "g"))
    got = {r["g"]: r for r in parts.groupBy("g").agg(F.sum(c2(F.col("m"))).alias("s"), F.sum("m").alias("n")).collect()}
    sij, n = (got[0]["s"] or 0.0, got[0]["n"] or 0) if got else (0.0, 0)
    sa, sb = (got[1]["s"] or 0.0, got[2]["s"] or 0.0) if got else (0.0, 0.0)
    total = c2(n)
    expected = sa * sb / total if total else 0.0
    maximum = (sa + sb) / 2.0
    ari = 1.0 if maximum == expected else (sij - expected) / (maximum - expected)
    return a.sparkSession.createDataFrame([(float(ari),)], "ari double")


# --- model comparison ----------------------------------------------------

def score_models(metrics: DataFrame) -> DataFrame:
    """Normalise (sil / max sil, min db / db, min wcss / wcss) and sum.

    ``metrics``: (model, model_order, silhouette_score, db_index, wcss); a
    handful of rows, one per model.
    """
    ext = metrics.agg(F.max("silhouette_score").alias("_smax"), F.min("db_index").alias("_dmin"),
                      F.min("wcss").alias("_wmin")).first()
    out = metrics.withColumns({
        "normalized_silhouette": F.try_divide(F.col("silhouette_score"), F.lit(ext["_smax"])),
        "normalized_db_index": F.try_divide(F.lit(ext["_dmin"]), F.col("db_index")),
        "normalized_wcss": F.try_divide(F.lit(ext["_wmin"]), F.col("wcss")),
    })
    return out.withColumn("combined_score", F.col("normalized_silhouette") + F.col("normalized_db_index")
                          + F.col("normalized_wcss"))


def optimum_model(scored: DataFrame) -> DataFrame:
    """The model with the greatest combined score; first in model order on a tie."""
    return (scored.orderBy(F.col("combined_score").desc_nulls_last(), F.col("model_order"))
            .limit(1).select("model", "combined_score"))
