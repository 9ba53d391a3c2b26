"""The queries that SQL can express, against it."""

import pytest
from compare import SF, same

from quirefold.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, SF), sql.ORACLES[name])
