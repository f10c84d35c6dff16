"""Every registered query gives the rows of its checking SQL."""

import glob
import math
import os

import duckdb
import pytest

from auditframe.queries import CHECKS, QUERIES
from tests.conftest import SF_DIR

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


#: The smallest tables lack rare rows, such as asserts in files whose name alone says that they are tests.
FOLDERS = [SF_DIR, "/root/testdata/sf0.01"]


@pytest.fixture(scope="module", params=FOLDERS, ids=os.path.basename)
def engine(request):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(request.param, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return request.param, con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{type(value).__name__}:{value}"


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(_cell(row[i]) for i in order) for row in rows)


def test_every_query_is_checked():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, engine):
    folder, con = engine
    df = QUERIES[name](spark, folder)
    result = con.execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {d[0]: str(d[1]) for d in result.description}
    for field in df.schema:
        assert TYPES[field.dataType.simpleString()] == kinds[field.name], field.name
    assert _sorted_rows(df.collect(), df.columns) == _sorted_rows(result.fetchall(), columns)
