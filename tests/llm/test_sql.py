import pytest
from oracle import check

from inkmill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
