"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry
from tests.compare import connect, differences
from tiffin.plans.oracles import ORACLES
from tiffin.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == []


def test_entry_gives_rows(spark):
    assert entry(spark).count() == 10
