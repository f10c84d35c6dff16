"""Every query of the subpackage that has checking SQL gives its rows."""

import glob
import os

import duckdb
import pytest

from auditframe.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(name, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want = con.execute(CHECKS[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
