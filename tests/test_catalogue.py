"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

import collections
import datetime
from pathlib import Path

import pytest

from termweave.plans import catalogue, engine, files  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.O))
def test_oracle(spark, duck, name):
    got = catalogue.Q[name](spark, DATA)
    want = duck.execute(catalogue.O[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    expected = collections.Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert collections.Counter(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.Q) - set(catalogue.O)))
def test_runs_without_oracle(spark, name):
    assert catalogue.Q[name](spark, DATA).columns
    catalogue.Q[name](spark, DATA).collect()
