"""Every query against its SQL on the smallest tables; those without SQL run and give rows."""

import duckdb
import pandas as pd
import pytest

from talus import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    value = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted(str(tuple(map(value, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Whole fits take long; their methods are tested on small surfaces.
SLOW = {"dh_minimize"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 60
