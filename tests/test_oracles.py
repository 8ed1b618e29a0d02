import pytest
from oracle import compare

from kinvec.plans import queries as library

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_same_rows_as_sql(spark, name):
    compare(spark, name, library.QUERIES[name], library.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0
