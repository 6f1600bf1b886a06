"""Every registered query of the mapping engine against its oracle, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from graphloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = oracle.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)
    assert want or name == "none"
