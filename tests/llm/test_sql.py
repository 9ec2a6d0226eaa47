"""Queries of the training-data operators that SQL can express, held against that SQL."""

import pytest

from spendlens.llm.queries import ORACLE, QUERIES
from spendlens.plans.check import duck

from paths import SF_SMALL


def result(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    found = QUERIES[name](spark, SF_SMALL)
    told = duck(SF_SMALL).execute(ORACLE[name])
    assert result(found.columns, map(tuple, found.collect())) == result([d[0] for d in told.description], told.fetchall())
