"""The registered text queries run on the smallest tables."""

import pytest

from caseframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, data):
    rows = queries.QUERIES[name](spark, data)
    got = [tuple(map(str, r)) for r in rows.collect()]
    assert rows.columns and len(set(got)) == len(got)
