"""The queries that SQL can express, on the smallest tables."""

import compare
import pytest

from catchment_engine.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    compare.same(queries.queries()[name](spark, SF), compare.connect(SF), queries.oracle_sql()[name])
