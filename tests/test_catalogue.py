"""Every query against its SQL in DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from windrow.plans import assembled, landed, sliced  # noqa: F401  they add their queries
from windrow.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(SF).iterdir():
            con.execute(f"create view {p.stem} as select * from '{p}'")
        pd.testing.assert_frame_equal(rows(got), rows(con.sql(ORACLES[name]).df()), check_dtype=False, atol=2e-4, rtol=1e-9)
