"""Exact quantiles (R type 7 / linear interpolation) with bounded state.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer, which does not survive a continuous measure over
billions of rows. This takes two passes, the same at every size:

1. ``percentile_approx`` brackets each wanted order statistic between two
   data values ``L <= x <= U`` (rank error at most n/accuracy each side), all
   columns, probabilities and groups in one aggregation;
2. one aggregation counts the values below ``L`` and the count per distinct
   value inside ``[L, U]`` (a window of about 4n/accuracy values), then a
   running count over that small window picks the exact order statistics.

Only the chosen values (two per group, column and probability) reach the
driver. Should a bracket miss, it is widened and the second pass repeated for
what is missing; the widest bracket holds all values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100000


def _interp(lo: float, hi: float, frac: float) -> float:
    return lo + (hi - lo) * frac if frac else lo


def _quantiles(df: DataFrame, group: str | None, cols: list[str], probs: list[float], accuracy: int) -> dict:
    """{(group value, col, p): quantile}; group value None without a group."""
    spark = df.sparkSession
    g_type = df.schema[group].dataType.simpleString() if group else "int"
    base = df.select((F.col(group) if group else F.lit(None).cast("int")).alias("_g"),
                     *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = [f"c{i}" for i in range(len(cols))]
    long = base.unpivot(["_g"], names, "name", "v").where(F.col("v").isNotNull())
    result: dict = {}
    todo = {(i, p) for i in range(len(cols)) for p in probs}
    todo_groups = None                                   # all groups at first
    eps = 2.0 / accuracy
    while todo:
        ps = sorted({p for _, p in todo})
        brackets = [b for p in ps for b in (max(0.0, p - eps), min(1.0, p + eps))]
        aggs = [F.count(c).alias(f"n_{c}") for c in names]
        aggs += [F.percentile_approx(c, brackets, accuracy).alias(f"b_{c}") for c in names]
        want = []
        for r in base.groupBy("_g").agg(*aggs).collect():
            for i, p in todo:
                if todo_groups is not None and (r["_g"], i, p) not in todo_groups:
                    continue
                n = r[f"n_c{i}"]
                if not n:
                    result[(r["_g"], cols[i], p)] = None
                    continue
                h = (n - 1) * p
                b, j = r[f"b_c{i}"], ps.index(p)
                want.append((r["_g"], f"c{i}", float(p), float(b[2 * j]), float(b[2 * j + 1]),
                             math.floor(h), math.ceil(h), h - math.floor(h)))
        if not want:
            break
        # one row per group, column and probability
        bounds = spark.createDataFrame([w[:7] for w in want], f"_bg {g_type}, bname string, p double, L double, "
                                                              "U double, lo_r bigint, hi_r bigint")
        # they came from the driver: sent to the rows, which otherwise all move to the few keys there are
        j = long.join(F.broadcast(bounds), long["_g"].eqNullSafe(bounds["_bg"]) & (long["name"] == bounds["bname"])
                      & (long["v"] <= bounds["U"]))
        cells = (j.groupBy("_g", "name", "p", "lo_r", "hi_r",
                           F.when(F.col("v") >= F.col("L"), F.col("v")).alias("val"))
                 .agg(F.count(F.lit(1)).alias("cnt")))
        w = Window.partitionBy("_g", "name", "p").orderBy(F.col("val").asc_nulls_first())
        cum = cells.withColumn("hi_c", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
                   .withColumn("lo_c", F.col("hi_c") - F.col("cnt"))
        picks = (cum.where(F.col("val").isNotNull()
                           & (((F.col("lo_c") <= F.col("lo_r")) & (F.col("lo_r") < F.col("hi_c")))
                              | ((F.col("lo_c") <= F.col("hi_r")) & (F.col("hi_r") < F.col("hi_c")))))
                 .select("_g", "name", "p", "val", "lo_c", "hi_c", "lo_r", "hi_r").collect())
        found: dict = {}
        for r in picks:
            d = found.setdefault((r["_g"], r["name"], r["p"]), {})
            if r["lo_c"] <= r["lo_r"] < r["hi_c"]:
                d["lo"] = r["val"]
            if r["lo_c"] <= r["hi_r"] < r["hi_c"]:
                d["hi"] = r["val"]
        missing = set()
        for g, name, p, *_, frac in want:
            d = found.get((g, name, p), {})
            i = int(name[1:])
            if "lo" in d and "hi" in d:
                result[(g, cols[i], p)] = _interp(d["lo"], d["hi"], frac)
            else:
                missing.add((g, i, p))
        todo, todo_groups = {(i, p) for _, i, p in missing}, missing
        eps *= 16
    return result


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = ACCURACY) -> dict[tuple[str, float], float | None]:
    """{(col, p): quantile} over the non-NULL values of each column."""
    cols, probs = list(cols), list(probs)
    got = _quantiles(df, None, cols, probs, accuracy)
    return {(c, p): got.get((None, c, p)) for c in cols for p in probs}


def grouped_quantiles(df: DataFrame, group: str, cols: Sequence[str], probs: Sequence[float],
                      accuracy: int = ACCURACY):
    """{(group value, col, p): quantile}, all groups in the same two passes."""
    return _quantiles(df, group, list(cols), list(probs), accuracy)
