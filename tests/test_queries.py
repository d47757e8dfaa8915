"""Every core query: against its SQL, or that it runs."""

import pytest

from leafstack.plans import queries as core
from tests.conftest import DATA
from tests.oracle import connect, same_rows

#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"jaccard_pairs", "load_with_vectors", "vector_codec", "retrieval_hit", "answer_rank"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, DATA)
    sql = core.oracle_sql().get(name)
    n = same_rows(df, con, sql) if sql else df.count()
    assert n > 0 or name in MAY_BE_EMPTY


def test_sql_only_for_queries():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_entry():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
