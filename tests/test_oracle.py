"""Every registered core query against its DuckDB SQL; those without SQL have to run."""

import math

import duckdb
import pytest

from lexforge.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return round(float(v), 7)

    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, data).toPandas()
    if name in ORACLE_SQL:
        columns, got = rows(found)
        wanted_columns, wanted = rows(duck.sql(ORACLE_SQL[name]).df())
        assert columns == wanted_columns
        assert got == wanted


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() >= ORACLE_SQL.keys()
    assert QUERIES["e03_funnel"](spark, data).count() == 5


def test_funnel_adds_up(spark, data):
    t = QUERIES["e01_funnel_totals"](spark, data).first()
    assert t["extracted"] + t["extraction_failed"] + t["extraction_pending"] == t["total"]
