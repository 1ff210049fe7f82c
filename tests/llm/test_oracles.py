import pytest

from tagtide.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, same, name):
    same(name, queries.queries()[name](spark, SMALL), queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
