"""Every query with an SQL twin matches DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0) > 0:
        return tuple(_norm(x) for x in list(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_sql(spark, con, name):
    sp = E.queries()[name](spark, SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dk)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "person_id"


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
