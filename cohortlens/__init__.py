"""cohortlens: cluster analysis of wide per-person measure tables on Spark.

Every operator takes and returns Spark DataFrames; only d x d matrices and
one-row statistics ever reach the driver.
"""

from cohortlens.schema import MEASURES  # noqa: F401
from cohortlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["MEASURES", "get_spark", "checkpoint_dir"]
