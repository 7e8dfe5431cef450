import os

import pytest

from maskwright.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import actual, expected

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    wanted, got = expected(DATA, ORACLE_SQL[name]), actual(QUERIES[name](spark, DATA))
    assert got[0] == wanted[0] and got[1] == wanted[1]
