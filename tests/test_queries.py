"""Every query of the derived views against its oracle."""

import pytest

from strandloom.plans import file_queries, queries

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_has_an_oracle():
    assert file_queries.query is queries.query
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
