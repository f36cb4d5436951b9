"""Wide <-> long reshaping and label look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_measures(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                     name: str = "name", value: str = "value") -> DataFrame:
    """Wide -> long (ids..., name, value); NULL values are kept.  No shuffle."""
    return df.unpivot(list(ids), list(cols), name, value)


def pivot_measures(long: DataFrame, id_col: str, names: Sequence[str],
                   name: str = "name", value: str = "value") -> DataFrame:
    """Long -> wide with an explicit value list (no extra distinct job)."""
    return long.groupBy(id_col).pivot(name, list(names)).agg(F.first(value))


def join_labels(long: DataFrame, lookup: DataFrame, name: str = "name") -> DataFrame:
    """Left join to a display-name lookup; unknown names keep a NULL label.

    The lookup is a literal table of a dozen rows, so it is broadcast.
    """
    return long.join(F.broadcast(lookup), long[name] == lookup["variable"], "left").drop("variable")
