"""Every query of the library's own operators against its DuckDB oracle at the smallest scale."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from itemspark.plans import catalog
from tools.check import TABLES, TYPES, canonical

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracles())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    want = rel.fetchall()
    theirs = {d[0]: str(d[1]) for d in rel.description}
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema} == theirs
    cols = sorted(theirs)
    pick = lambda rows, names: collections.Counter(tuple(canonical(r[names.index(c)]) for c in cols) for r in rows)
    assert pick([tuple(r) for r in df.collect()], df.columns) == pick(want, list(theirs))


def test_entry(spark):
    assert entry.entry(spark).count() == 6
