"""Registered graph queries against their SQL in DuckDB, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

from kmerloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for name in ("part", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: "Float64" for c in frame.columns if frame[c].isna().any() and pd.api.types.is_numeric_dtype(frame[c])})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def test_every_graph_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, FOLDER).toPandas()), ordered(duck.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)
    assert len(got)
