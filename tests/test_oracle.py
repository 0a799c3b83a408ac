"""Every catalogue query against its DuckDB oracle (the driver's check) on sf0.001."""

import os

import pytest

from tools.check_oracle import TABLES, digest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def _keys():
    from postlake.plans.catalog import QUERIES, load_all
    load_all()
    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    from postlake.plans.catalog import ORACLE, QUERIES
    sdf = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    if key not in ORACLE:
        return
    cur = duck.execute(ORACLE[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
