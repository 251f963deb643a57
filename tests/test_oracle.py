"""Every analysis with an oracle returns the same rows as its SQL in DuckDB
on the driver tables at sf0.01 (the driver's correctness setting)."""

import os

import duckdb
import pytest

from gravis.plans import catalogue as E
from scripts.check_oracle import TABLES, _rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    s_cols, s_rows = _rows(E.queries()[name](spark, SF).toPandas())
    o_cols, o_rows = _rows(con.sql(E.oracle_sql()[name]).df())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert {"mes_sinistro", "fatal_rate", "posicao"} <= set(df.columns)
