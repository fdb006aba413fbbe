"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lumasift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def rows_of(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert len(got.columns)
        return
    assert rows_of(got) == rows_of(duck.execute(sql).df())


def test_entry_has_the_flagship():
    assert "site_verdicts" in catalogue.queries()
