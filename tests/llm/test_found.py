"""The p-queries of this package on the smallest tables: rows, columns, and equal to their SQL."""

from pathlib import Path

import duckdb
import pytest

from sheafline.llm import modules

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for m in modules() for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in modules() for k, v in m.ORACLES.items()}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert got == sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
