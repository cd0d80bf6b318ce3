"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from cuemill.plans import registry

DATA = "/root/testdata/sf0.001"
#: The tests that hold queries without SQL against plain Python; each names its query.
BRUTE = "".join(open(os.path.join(os.path.dirname(__file__), f"test_{n}.py")).read() for n in ("brute", "align", "sentences", "canonical"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    kind = type(v).__name__
    if "bool" in kind:
        return bool(v)
    if "int" in kind:
        return int(v)
    if "float" in kind:
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return str(v)


def rows(frame):
    return sorted(map(repr, (tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.SQL:  # these are held against plain Python instead
        assert len(got) and f'"{name}"' in BRUTE, name
        return
    want = db.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
