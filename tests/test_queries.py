"""Every registered query against its SQL in another engine; those without run and have columns."""

import pytest

from caseframe.plans import filters, joins, problem_sql, problems, protocols, readers, registry, scalars, scans  # noqa: F401
from compare import connect, spark_rows, sql_rows

QUERIES = {**registry.QUERIES, **problems.QUERIES}
SQL = {**registry.SQL, **problem_sql.SQL}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    got = spark_rows(QUERIES[name](spark, data))
    assert got[0]
    if name in SQL:
        assert got == sql_rows(duck, SQL[name])
