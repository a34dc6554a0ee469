"""Every registered query against its SQL, on the smallest tables, as values of any order."""

import glob
import math
import os

import duckdb
import pytest

from gristmill.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: compared with plain programs elsewhere, as SQL can't express them on whole tables
WITHOUT = {"quote_validation", "minhash_pairs", "campaigns", "families"}


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, int | bool) else str(v)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_all_but_a_few_have_sql():
    assert QUERIES.keys() - SQL.keys() == WITHOUT


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, sf, tables, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    found = tables.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == names
    assert mine == sorted((tuple(plain(r[at[n]]) for n in names) for r in found.fetchall()), key=repr)
