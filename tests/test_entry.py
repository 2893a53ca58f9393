import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.plans import catalogue

SOME = ["bigram", "between_star", "generalise_any", "traditional_tree_growth", "dag_bigram", "item_freqs", "merged", "weighted_support"]


def compare(spark, testdata, name):
    df = entry.queries()[name](spark, testdata)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(testdata):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{testdata}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, testdata, name):
    compare(spark, testdata, name)


def test_entry_and_names(spark):
    assert set(catalogue.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["pattern", "support"]
