import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare

from kinvec import llm

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compare(spark, name, llm.queries()[name], llm.oracle_sql()[name], SF)
