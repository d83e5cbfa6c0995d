"""Every registered query of the engine proper against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from candlewright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, int | float) or type(x).__name__.startswith(("int", "float")):
            return repr(float(x))
        return str(pd.Timestamp(x)) if type(x).__name__ in ("Timestamp", "datetime64", "datetime", "date") else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    a = catalog.queries()[name](spark, sf_dir).toPandas()
    b = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"walk_forward", "walk_forward_stitched"}))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    """The smallest tables are too sparse for signals; the next larger ones aren't."""
    big = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    assert catalog.queries()[name](spark, big if os.path.isdir(big) else sf_dir).count() > 0
