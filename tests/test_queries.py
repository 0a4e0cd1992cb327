"""Every registered query of the presence operators against its SQL on the small tables."""

import os

import oracle
import pytest

from presflow import plans

if not os.path.isdir(oracle.SF):
    pytest.skip("the test tables are not here", allow_module_level=True)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    query, sql = plans.queries()[name], plans.oracle_sql().get(name)
    if sql:
        oracle.compare(spark, query, sql)
    else:
        assert query(spark, oracle.SF).count() >= 0
