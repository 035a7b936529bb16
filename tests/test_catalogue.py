import datetime as dt
import math
import os

import duckdb
import pytest

from foliospark.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_values_match(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in SQL:
        assert columns and (rows or name == "json_first_object")
        return
    found = tables.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()) == rows


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
