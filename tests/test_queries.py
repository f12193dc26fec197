"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from kinetra.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def _rows(rows, columns, order):
    def norm(v):
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    at = [columns.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert _rows([tuple(r) for r in got.collect()], got.columns, order) == _rows(want.fetchall(), want.columns, order)


def test_candidate_paths_are_loop_free(spark):
    rows = catalog.candidate_paths(spark, FOLDER).collect()
    assert rows
    for r in rows:
        species = r["species"].split(" > ")
        assert len(set(species)) == len(species) and 1 <= r["rank"] <= 20
