"""Every registered query against its SQL on the smallest tables, without the corpus operators."""

import pytest
from oracle import DATA, database, rows_of, rows_of_sql

from tonewright.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, DATA))
    assert rows
    if name in SQL:
        assert (names, rows) == rows_of_sql(con, SQL[name])


def test_entry_without_corpus_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
