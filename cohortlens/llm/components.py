"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (with map-side combining) and a join back, so a
hub never has its neighbours gathered in one place. Every round is written to
the shared folder, which cuts the lineage; rounds go on until the edge set
does not change, about log(n) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import stage_path, stages_dropper


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the first two columns of ``edges``.

    ``root`` is the smallest node of the component; nodes without an edge to
    another node are not returned. Self-links and repeated edges are harmless.
    """
    spark = edges.sparkSession
    drop = stages_dropper(spark)
    a, b = edges.columns[:2]

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = stage_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    e, path = write(edges.where(f"`{a}` != `{b}`")
                    .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                    .distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the smallest of u's neighbourhood
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u != v").distinct())
        new, new_path = write(small)
        new_state = _state(new)
        drop(path)
        e, path = new, new_path
        if new_state == state:
            break
        state = new_state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
