"""Every query of the core over the smallest tables, against its SQL twin."""

import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from corpusforge.plans import catalog

DIR = os.environ.get("CORPUSFORGE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in catalog.SQL:
        return
    r = con.execute(catalog.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted((tuple(plain(x[n]) for n in order) for x in rows), key=repr)
    b = sorted((tuple(plain(x[names.index(n)]) for n in order) for x in r.fetchall()), key=repr)
    assert a == b
