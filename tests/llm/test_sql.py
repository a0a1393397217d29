"""Queries that SQL can express give what their SQL gives."""

import pytest

from modelsieve.llm.queries import ORACLE, QUERIES
from tests.conftest import SF
from tools.check_oracle import connect, rows_of


@pytest.mark.parametrize("name", ["op1_arc_to_warc", "op3_chat_events", "op4_epsilon_grid_join"])
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(connect(SF).execute(ORACLE[name]).df())
