"""Bounded leaves: recursive median splits with bounding boxes.

Rows are split at the median of the widest measure until a leaf holds about
``leaf_rows`` rows. A pass splits every oversized leaf up to ``FAN`` ways: its
cuts come from a bounded sample of its rows, made in one task per leaf, and the
rows find their way down in a JVM expression. Rows that no cut can part (all
equal in the sample) are dealt by hash instead; such leaves share a box. Three
passes make 64^3 leaves. All later work asks the *boxes*, which are exact, so
neither sample nor ties touch any result.

``near_leaves`` walks down the levels and never compares all leaves with all
others: a leaf meets the children of a node only if the node is near. ``visit``
copies rows to leaves not their own; a leaf with many guests meets them in
chunks of ``GUESTS`` rows, so a task holds one leaf and one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.schema import ID
from cohortlens.session import ship_package, write_stage

DEPTH = 6
FAN = 1 << DEPTH            # children of a node
SAMPLE = 16_384             # rows of a leaf that set its cuts
LEAF_ROWS = 60_000          # rows of a leaf, at most about twice
GUESTS = 100_000            # visiting rows that a task holds


@dataclass
class Leaves:
    """``rows`` (key, measures, kept columns, leaf); ``levels`` of nodes (node, parent, n, lo_*, hi_*), leaves last."""

    rows: DataFrame
    levels: list[DataFrame]
    cols: list[str]
    key: str

    @property
    def boxes(self) -> DataFrame:
        return self.levels[-1].withColumnRenamed("node", "leaf")


def measures(table: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in cols]) if table.num_rows else np.zeros((0, len(cols)))


def usable(cols: Sequence[str]) -> Column:
    """Rows whose measures are all numbers."""
    return F.expr(" AND ".join(f"(`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS double)))" for c in cols))


def _squares(terms: Sequence[str]) -> Column:
    # one parsed expression: hundreds of Column calls cost more than the job
    return F.expr(" + ".join(f"({t}) * ({t})" for t in terms))


def row_to_box(cols: Sequence[str]) -> Column:
    """Squared distance of a row to the box ``lo_*``, ``hi_*`` in the same record."""
    return _squares([f"greatest(`lo_{c}` - `{c}`, `{c}` - `hi_{c}`, 0D)" for c in cols])


def box_to_box(cols: Sequence[str], a: str, b: str) -> Column:
    """Squared distance of boxes in columns ``{a}lo_*``, ``{a}hi_*`` and ``{b}lo_*``, ``{b}hi_*``."""
    return _squares([f"greatest(`{a}lo_{c}` - `{b}hi_{c}`, `{b}lo_{c}` - `{a}hi_{c}`, 0D)" for c in cols])


def box_columns(cols: Sequence[str]) -> list[str]:
    return [f"{side}_{c}" for c in cols for side in ("lo", "hi")]


def box_of(cols: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{side}_{c}") for c in cols for side, f in (("lo", F.min), ("hi", F.max))]


def median_cuts(x: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """(measure, cut) of each inner node in heap order; -1: all its rows go left. Right is above the cut."""
    dims, cuts = [-1] * FAN, [0.0] * FAN
    todo = [(1, np.arange(len(x)), depth)]
    while todo:
        node, at, left = todo.pop()
        if not left or len(at) < 2:
            continue
        own = x[at]
        lo, hi = own.min(axis=0), own.max(axis=0)
        j = int((hi - lo).argmax())
        if not hi[j] > lo[j]:
            continue
        cut = float(np.partition(own[:, j], (len(at) - 1) // 2)[(len(at) - 1) // 2])
        if cut >= hi[j]:
            cut = float(lo[j] + (hi[j] - lo[j]) / 2)
            cut = float(lo[j]) if cut >= hi[j] else cut
        dims[node], cuts[node] = j, cut
        right = own[:, j] > cut
        todo += [(2 * node, at[~right], left - 1), (2 * node + 1, at[right], left - 1)]
    return dims, cuts


def _plan(cols: list[str], leaf_rows: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].iloc[0])
        depth = min(DEPTH, math.ceil(math.log2(n / leaf_rows)))
        dims, cuts = median_cuts(pdf[cols].to_numpy(float), depth)
        # equal rows only: dealt by hash
        parts = min(FAN, math.ceil(n / leaf_rows)) if dims[1] < 0 else 0
        # nodes that do not split further keep to the left
        return pd.DataFrame({"leaf": [int(pdf["leaf"].iloc[0])], "dims": [dims], "cuts": [cuts], "parts": [parts]})
    return plan


def leaf_size(df: DataFrame, n: int, most: int = LEAF_ROWS) -> int:
    """Leaves enough for all cores, of 1,000 rows or more, and no larger than ``most``."""
    return max(1000, min(most, n // (2 * df.sparkSession.sparkContext.defaultParallelism)))


def grow(df: DataFrame, cols: Sequence[str], key: str = ID, leaf_rows: int | None = None, keep: Sequence[str] = ()
         ) -> Leaves:
    """Deal the rows of ``df`` with usable measures to leaves; ``keep``: further columns to carry along."""
    ship_package(df.sparkSession)
    cols = list(cols)
    rows = write_stage(df.where(usable(cols)).select(key, *keep, *[F.col(c).cast("double").alias(c) for c in cols],
                                                     F.lit(0).cast("bigint").alias("leaf")), "leaf-rows")
    leaf_rows = leaf_rows or leaf_size(df, rows.count())
    passes = 0
    while True:
        sizes = write_stage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * leaf_rows),
                            "leaf-sizes")
        if passes and sizes.limit(1).count() == 0:
            break
        passes += 1
        draw = F.pmod(F.xxhash64(key, F.lit(passes)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("_n")
        cuts = write_stage(rows.join(sizes, "leaf").where(draw).select("leaf", "_n", *cols).groupBy("leaf").applyInPandas(
            _plan(cols, leaf_rows), "leaf bigint, dims array<int>, cuts array<double>, parts int"), "leaf-cuts")
        xs = F.array(*cols)

        def down(node, _):
            dim = F.get(F.col("dims"), node)
            above = (dim >= 0) & (F.get(xs, dim) > F.get(F.col("cuts"), node))
            return 2 * node + F.coalesce(above, F.lit(False)).cast("int")

        child = (F.when(F.col("dims").isNull(), 0)
                 .when(F.col("parts") > 0, F.pmod(F.xxhash64(F.lit(passes), key), F.col("parts")).cast("int"))
                 .otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), down) - FAN))
        rows = write_stage(rows.join(cuts, "leaf", "left").select(
            key, *keep, *cols, (F.col("leaf") * FAN + child).alias("leaf")), "leaf-rows")
    level = (rows.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *box_of(cols))
             .withColumn("parent", F.floor(F.col("node") / FAN)))
    levels = [write_stage(level, "leaf-boxes")]
    for _ in range(passes - 1):
        below = levels[0]
        level = (below.groupBy(F.col("parent").alias("node"))
                 .agg(F.sum("n").alias("n"), *[f(c).alias(c) for m in cols for c, f in ((f"lo_{m}", F.min), (f"hi_{m}", F.max))])
                 .withColumn("parent", F.floor(F.col("node") / FAN)))
        levels.insert(0, write_stage(level, "leaf-boxes"))
    return Leaves(rows, levels, cols, key)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over several partitions a core: the rows of leaves are few bytes for much work, and adaptive
    execution would gather them in one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def near_leaves(tree: Leaves, reach: DataFrame) -> DataFrame:
    """(leaf, to, centres, lo_*, hi_*): the leaves whose box is within ``r`` of the box of ``leaf``, itself included.

    ``reach``: (leaf, r), the leaves that ask. The box is that of ``to``; ``centres`` is the squared distance of
    the two boxes' centres.
    """
    cols = tree.cols
    cur = tree.boxes.join(reach, "leaf").select(
        "leaf", "r", *[F.col(c).alias(f"q_{c}") for c in box_columns(cols)], F.lit(0).cast("bigint").alias("at"))
    asks = cur.columns[:-1]
    for level in tree.levels:
        nodes = level.select("node", F.col("parent").alias("at"), *box_columns(cols))
        cur = (cur.select(*asks, "at").join(nodes, "at")
               .where(box_to_box(cols, "q_", "") <= F.col("r") * F.col("r") * (1 + 1e-9))
               .select(*asks, F.col("node").alias("at"), *box_columns(cols)))
    centres = _squares([f"(`lo_{c}` + `hi_{c}` - `q_lo_{c}` - `q_hi_{c}`) / 2" for c in cols])
    return cur.select("leaf", F.col("at").alias("to"), centres.alias("centres"), *box_columns(cols))


def visit(home: DataFrame, guests: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key: str = ID,
          guest_rows: int = GUESTS) -> DataFrame:
    """``fn(own rows, guests)`` for every leaf of ``home`` and every chunk of the ``guests`` sent ``to`` it."""
    chunks = guests.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / guest_rows).cast("int").alias("chunks"))
    sent = (guests.join(chunks, "to").withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), key), F.col("chunks")).cast("int"))
            .drop("chunks"))
    host = (home.join(chunks.withColumnRenamed("to", "leaf"), "leaf")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks"))
    # the two sides come from one table: own names for the keys of the guests
    sent = sent.select(*[F.col(c).alias(f"g_{c}") for c in sent.columns])

    def both(own: pa.Table, come: pa.Table) -> pa.Table:
        return fn(own, come.rename_columns([c[2:] for c in come.column_names]))

    return (dealt(host, "leaf", "chunk").groupBy("leaf", "chunk")
            .cogroup(dealt(sent, "g_to", "g_chunk").groupBy("g_to", "g_chunk")).applyInArrow(both, schema))
