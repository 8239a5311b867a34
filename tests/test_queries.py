import pytest

from millrace import queries
from tests.compare import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    cols, rows = rows_of(queries.QUERIES[name](spark, small))
    if name in queries.ORACLE_SQL:
        assert (cols, rows) == duck_rows(queries.ORACLE_SQL[name], small)
    else:
        assert rows


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
