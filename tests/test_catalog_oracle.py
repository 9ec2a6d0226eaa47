"""Every catalogue query against its DuckDB SQL on the smallest test scale."""

import pytest

from spendlens.plans.catalog import QUERIES
from spendlens.plans.check import compare, duck
from spendlens.plans.oracle import ORACLE

from paths import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, [name], con)[name]
    assert res.get("values"), res


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["yr", "c1", "c2", "g"] and df.count() > 0
    # training-data queries that SQL cannot express have their brute-force tests instead
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
