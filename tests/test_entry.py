import duckdb
import pytest

import __spark_entry__ as E
from langatlas.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "location", "lat", "lng", "density"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    drows = res.fetchall()
    idx = [dcols.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=key)
    ref = sorted((tuple(_norm(r[i]) for i in idx) for r in drows), key=key)
    assert ours == ref
