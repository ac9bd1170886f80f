"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import datetime

import duckdb
import pytest

from cataloom.plans import files as files
from cataloom.plans import maintenance as maintenance
from cataloom.plans import parsing as parsing
from cataloom.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return str(v) if isinstance(v, datetime.date) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(plans.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
