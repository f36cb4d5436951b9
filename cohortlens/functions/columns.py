"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake_case(name: str) -> str:
    """Column name to snake_case: split camelCase, non-alphanumerics to '_'."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()
    s = re.sub(r"_+", "_", s)
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def lenient_double(col: str | Column) -> Column:
    """Text to double; anything unparsable ("NA", "NULL", "") becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).try_cast(T.DoubleType())


def uniform01(key: str | Column, salt: str) -> Column:
    """Deterministic uniform draw in [0, 1) from a key and a salt.

    First 60 bits of md5(key || '|' || salt), enough to reach every rank of a
    distribution up to the 53 bits of a double; the same value is reproducible
    in any SQL engine with md5, so imputed draws can be checked row by row.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit("|" + salt))), 1, 15), 16, 10)
    # the low bits go first: rounding up to 1.0 is impossible
    return F.shiftright(h.cast("bigint"), 7).cast("double") / F.lit(float(1 << 53))


def draw_rank(u: Column, total: Column) -> Column:
    """Rank r in [0, total) of a weighted draw: floor(u * total)."""
    return F.floor(u * total.cast("double")).cast("bigint")


def sq_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance between two equal-length column lists."""
    terms = [(x - y) * (x - y) for x, y in zip(a, b)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sq_distance(a, b))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (for engine-independent comparisons)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation that is NULL (not an ANSI error) for a constant column."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
