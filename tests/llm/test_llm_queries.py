import pytest

from oracle_check import compare, connect
from peerwatch.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toArrow()
    assert compare(got, connect(sf_dir).sql(queries.ORACLES[name]).to_arrow_table()) == []
