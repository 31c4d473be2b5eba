"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quarry.plans.queries import ORACLE_SQL, QUERIES

TABLES = "documents labels pages lineitem events benchmark".split()
CHOSEN = sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    return sorted(str(x).replace("None", "nan") for x in frame[names].itertuples(index=False, name=None)), names


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sql, small, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(sql.execute(ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
