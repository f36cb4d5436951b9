"""Distributed running totals (prefix sums) without a one-task window.

``Window.partitionBy(k).orderBy(x)`` sends every row of a key to one task; a
running count over all distinct values of a continuous measure would then
sit in a single task.  Instead the rows are range-partitioned on (keys,
order) -- even splits, since order values are unique within a key -- each
task sums its own slice, and a small table of per-(partition, key) totals
(at most partitions + keys rows) gives every slice its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import write_stage


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  out: str = "cum", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` within ``keys`` by ``order``.

    ``order`` must be unique within each key (e.g. distinct values with counts).
    """
    keys, order = list(keys), list(order)
    parts = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # materialise once so the totals and the rows come from the same range split
    ranged = write_stage(ranged.withColumn("_local", F.sum(value).over(local)), "ranged")
    totals = ranged.groupBy("_pid", *keys).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return (ranged.join(offsets.select("_pid", *keys, "_off"), ["_pid", *keys])
            .withColumn(out, F.col("_local") + F.col("_off"))
            .drop("_pid", "_local", "_off"))
