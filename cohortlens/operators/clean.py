"""Cleaning: names, lenient casts, zero fills, duplicate persons, missing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import lenient_double, snake_case
from cohortlens.schema import DATES, ID, TEXT_MEASURES, ZERO_FILL


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case (duplicates get a numeric suffix)."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        s = snake_case(c)
        if s in seen:
            seen[s] += 1
            s = f"{s}_{seen[s]}"
        else:
            seen[s] = 1
        names.append(s)
    return df.toDF(*names)


def cast_measures(df: DataFrame, cols: Sequence[str] = TEXT_MEASURES) -> DataFrame:
    """Lenient text -> double cast; unparsable values become NULL."""
    return df.withColumns({c: lenient_double(c) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] = ZERO_FILL) -> DataFrame:
    """Missing means none: NULL -> 0 for the given columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def drop_dates(df: DataFrame, cols: Sequence[str] = DATES) -> DataFrame:
    return df.drop(*cols)


def count_per_person(df: DataFrame, key: str = ID) -> DataFrame:
    """(key, n): rows per person.  Partial aggregation keeps a hot key cheap."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def duplicated_ids(df: DataFrame, key: str = ID) -> DataFrame:
    """Keys that occur more than once."""
    return count_per_person(df, key).where(F.col("n") > 1).select(key)


def drop_duplicated(df: DataFrame, key: str = ID) -> DataFrame:
    """Drop *every* row of a duplicated key (anti-join on the duplicated keys).

    The duplicated-key table is an aggregate, usually tiny, so AQE turns the
    anti-join into a broadcast; a large one stays a sort-merge anti-join, with
    AQE splitting a skewed key on the big side.
    """
    return df.join(duplicated_ids(df, key), on=key, how="left_anti")


def missing_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total number of missing cells (NULL, or NaN for floating columns)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else list(fields)
    terms = []
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(fields[c], (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        terms.append(F.count_if(miss))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.agg(total.cast("bigint").alias("n_missing"))


def reduce_raw(raw: DataFrame) -> DataFrame:
    """Raw extract -> one clean row per person: cast, drop dates, zero-fill, de-duplicate."""
    df = cast_measures(clean_names(raw))
    df = fill_zero(drop_dates(df))
    return drop_duplicated(df)
