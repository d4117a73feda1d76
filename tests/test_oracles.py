"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import compare, duck
from corpusmill.plans.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# queries whose smallest-table result may well be empty
MAY_BE_EMPTY = {"knn_minmax", "filter_meta_both", "containment_join", "path_include_exclude", "delete_ids"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    ok, note = compare(name, spark, con, SF)
    assert ok, note
    if name not in MAY_BE_EMPTY:
        assert "rows=0 " not in note, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
