"""Every registered query against its SQL on DuckDB, over the whole tables."""

import pytest

import __spark_entry__ as entry
from benchset import check, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert check.compare(spark, duck, SF, name, registry.QUERIES[name], registry.SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5
