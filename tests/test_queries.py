"""Every registered query at the smallest scale, compared with its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from marginalia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "NULL"
        return f"{float(v):.5f}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: [cell(v) for v in df[c]] for c in df.columns})
    numeric = {c for c in df.columns if df[c].dtype.kind in "fi"}
    for c in numeric:
        out[c] = ["NULL" if v == "NULL" else f"{float(v):.5f}" for v in out[c]]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, engine, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = engine.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
