"""Queries against their SQL twins, on the smallest tables."""

import os

import duckdb
import pytest

from evispark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"locate_benchmark"}


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [normal(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if n not in SLOW])
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(([normal(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(([normal(r[i]) for i in at] for r in rel.fetchall()), key=repr)
