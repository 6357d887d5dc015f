"""Every registered query against its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from cadenza import plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    found, expected = plans.QUERIES[name](spark, str(DATA)).toArrow(), duck.execute(plans.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(expected.column_names)
    assert [found.schema.field(c).type for c in columns] == [expected.schema.field(c).type for c in columns]
    a, b = (t.select(columns).to_pandas().sort_values(columns, ignore_index=True) for t in (found, expected))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_flagship_is_registered():
    assert plans.FLAGSHIP in plans.QUERIES
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
