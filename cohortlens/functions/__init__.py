"""Column-level helpers (all JVM-side expressions, no Python UDFs)."""

from cohortlens.functions.columns import (  # noqa: F401
    snake_case, lenient_double, uniform01, draw_rank, sq_distance, distance, round_doubles,
)
