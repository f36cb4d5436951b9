"""Mixing sources to target weights by pivotal dependent rounding.

Every text has a fractional number of copies: its source's target divided by
its source's size. The whole part is taken as it is; the fractional parts of a
source are rounded dependently. Two texts at a time, mass (in words) is moved
at random from one to the other until one of them is integral, which keeps
every text's expected copies and the source's total of words. A source is cut
into hashed buckets of bounded size; each bucket leaves at most one fractional
text, and these residuals are combined in a tree of further rounds until one
text per source is left, which is rounded by its own probability. So a
source's words miss the target by at most one text.

Randomness comes from a keyed hash of the row, so reruns agree whatever the
partitioning. Defined results: null text has size 0 and takes 0; null source
is a source of its own, ordered last; repeated rows are separate texts, counted
and numbered, each with a random key of its own; a text of any length counts as
one; sources of no words have target 0; an empty table gives no rows; of the
input only id, source and text are read, so further columns of any name do no
harm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from cohortlens.llm.common import numbered_copies, stage, start

WORD = r"[^\x20\x09-\x0D]+"
FANIN = 64          # residuals combined by one group of the tree
BUCKET_ROWS = 4096  # rows of a first-level group (expected)


def word_count(col="text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_order(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, rank): rank from 0 by code point, null last.

    The rank is counted from range partitions of the source table, so no task
    holds all sources.
    """
    src = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
                .repartitionByRange(F.col("source").asc_nulls_last()), "mix-sources")
    part = (src.withColumn("part", F.input_file_name()))
    first = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"),
                                     F.min(F.struct(F.col("source").isNull().alias("z"), "source")).alias("lo"))
    # one row per file of the range partitioning, at most the number of shuffle partitions
    first = first.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return (part.withColumn("r", inside).join(first.select("part", "before"), "part")
            .select("source", "source_size", "n_rows", (F.col("r") - 1 + F.col("before")).alias("rank")))


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
            cap: int = 2) -> DataFrame:
    """Add ``target``: weights share ``share`` of all words; no target above ``cap`` x its source.

    Water level: sources at their cap are taken out and the rest is shared by
    weight again, until no further source reaches its cap. Each round is one
    aggregation to a single row.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stage(sources.withColumn("w", w.cast("long")), "mix-weights")
    num, den = share
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        full = F.col("w") * F.lit(level) >= cap * F.col("source_size")
        row = src.agg(F.sum(full.cast("long")).alias("n"),
                      F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("s"),
                      F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)).alias("w")).first()
        if not row["w"] or row["n"] == n_capped:
            break
        n_capped = row["n"]
        level = (num * total - cap * den * int(row["s"])) / (den * int(row["w"]))
    full = F.col("w") * F.lit(level) >= cap * F.col("source_size")
    return src.withColumn("target", F.when(full, (cap * F.col("source_size")).cast("double"))
                          .otherwise(F.col("w") * F.lit(level)))


def pivot_round(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``p`` pairwise, keeping sum(p * size); (values, index still fractional or -1)."""
    p = p.tolist()
    size, u = size.tolist(), u.tolist()
    carry = -1
    for j, pj in enumerate(p):
        if pj <= 0.0 or pj >= 1.0:
            continue
        if carry < 0:
            carry = j
            continue
        pi, ratio = p[carry], size[carry] / size[j]       # 1 of carry weighs ``ratio`` of j
        up, down = min(1.0 - pi, pj / ratio), min(pi, (1.0 - pj) / ratio)
        if u[j] * (up + down) < down:                      # carry gains ``up``, j pays for it
            full_i, pi, pj = up == 1.0 - pi, pi + up, pj - up * ratio
            pi, pj = (1.0, pj) if full_i else (pi, 0.0)
        else:
            full_i, pi, pj = down == pi, pi - down, pj + down * ratio
            pi, pj = (0.0, pj) if full_i else (pi, 1.0)
        p[carry], p[j] = pi, min(max(pj, 0.0), 1.0)
        if full_i:
            carry = j if 0.0 < p[j] < 1.0 else -1
    return np.array(p), carry


def _uniform(keys: pd.Series, salt: int) -> np.ndarray:
    from cohortlens.llm.common import U64, mix
    k = mix(keys.to_numpy(np.int64).view(np.uint64) ^ mix(np.array([salt + 1], np.uint64)))
    return (k >> U64(11)).astype(np.float64) / float(1 << 53)


def round_copies(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``copies`` to (source, size, p, key, n_rows, ...): p rounded to 0 or 1 within its source."""
    start(rows)
    cols = rows.schema
    rows = rows.withColumn("buckets", F.pow(2.0, F.ceil(F.log2(F.greatest(
        F.lit(1.0), F.col("n_rows") / BUCKET_ROWS)))).cast("long"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")))
    decided = rows.where("size = 0 or p <= 0 or p >= 1").withColumn(
        "copies", F.when(F.col("p") >= 1, 1).otherwise(0).cast("long"))
    open_ = rows.where("size > 0 and p > 0 and p < 1")
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField("copies", LongType())])

    def run(level: int):
        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
            p, rest = pivot_round(pdf["p"].to_numpy(), pdf["size"].to_numpy(np.float64),
                                  _uniform(pdf["key"], seed * 1000 + level))
            copies = pd.Series(np.rint(p).astype(np.int64)).astype("Int64")
            if rest >= 0 and pdf["buckets"].iloc[0] <= 1:       # the source's last one: by its own probability
                u = _uniform(pdf["key"].iloc[[rest]], seed * 1000 + 999)[0]
                copies[rest] = int(u < p[rest])
            elif rest >= 0:
                copies[rest] = pd.NA
            pdf["p"], pdf["copies"] = p, copies
            return pdf
        return f

    parts, level = [decided], 0
    most = rows.agg(F.max("buckets")).first()[0] or 1
    while True:
        done = stage(open_.groupBy("source", "bucket").applyInPandas(run(level), schema), f"mix-round{level}")
        parts.append(done.where("copies is not null"))
        if most <= 1:
            break
        open_ = (done.where("copies is null").drop("copies")
                 .withColumn("buckets", F.ceil(F.col("buckets") / FANIN))
                 .withColumn("bucket", F.pmod(F.col("bucket"), F.col("buckets"))))
        most = -(-most // FANIN)
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*cols.fieldNames(), "copies")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
                cap: int = 2, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) for every row of ``docs``."""
    sizes = stage(numbered_copies(docs.select(F.col(id_col), F.col("source").cast("string").alias("source"),
                                              word_count("text").alias("size"))), "mix-sizes")
    src = targets(source_order(sizes), weights, share, cap)
    info = src.select(F.col("source").alias("s"), "source_size", "n_rows", "target")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sizes.join(info, sizes.source.eqNullSafe(info.s)).drop("s")
            .withColumn("whole", F.floor(x)).withColumn("p", x - F.floor(x))
            .withColumn("key", F.xxhash64(F.col(id_col), "size", "source", "copy")).drop("copy"))
    out = round_copies(rows, seed)
    return out.select(id_col, "size", "source", "source_size", "target",
                      (F.col("whole") + F.col("copies")).alias("copies"),
                      ((F.col("whole") + F.col("copies")) * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
              cap: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows are met again by a hash of id and text. Equal rows are
    interchangeable: they share out the copies of all of them. Only rows that
    cannot share them evenly are numbered; the others pass the join as they
    come, so whole texts are not sorted.
    """

    row_key = F.xxhash64(F.col(id_col), F.col(text_col))
    mixed = mix_sources(docs.select(row_key.alias("row"), "source", F.col(text_col).alias("text")), weights, share,
                        cap, seed, "row")
    taken = stage(mixed.groupBy("row").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"))
                  .where("c > 0"), "mix-copies")
    rows = docs.select(row_key.alias("row"), F.struct("*").alias("doc"))           # no column can clash

    def met(which: str) -> DataFrame:
        # the narrow side is the hash table
        return rows.join(taken.where(which).hint("shuffle_hash"), "row")

    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    share_of = F.floor(F.col("c") / F.col("n"))
    even = met("c % n = 0").select("doc", share_of.alias("k"))
    uneven = (met("c % n > 0").withColumn("nth", nth)
              .select("doc", (share_of + (F.col("nth") <= F.col("c") % F.col("n")).cast("long")).alias("k")))
    return (even.unionByName(uneven).where("k > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
            .select("doc.*"))
