"""Sources and sinks: driver tables, the measure table, lookups, CSV/table I/O."""

from cohortlens.sources.tables import read_table  # noqa: F401
from cohortlens.sources.measures import key_measures_raw  # noqa: F401
from cohortlens.sources.lookups import measure_lookup, model_lookup  # noqa: F401
