"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tests.check_queries import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, FOLDER)
    assert ok, text


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.classification for r in rows} == {2, 5, 6}
