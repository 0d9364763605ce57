"""Every registered query of the screening engine against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sievewall import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return "~"
    if isinstance(value, (bool, str)) or type(value).__name__ == "bool":
        return str(value)
    return f"{float(value):.9g}"


def rows(frame: pd.DataFrame):
    return sorted(tuple(normal(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{Path(SF, name)}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = plans.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_query_without_sql_is_known():
    assert set(plans.queries()) - set(plans.oracle_sql()) == set()
