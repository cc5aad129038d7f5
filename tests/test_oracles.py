"""Every registered query of the bar library against its DuckDB form."""

import os

import pytest

from compare import assert_same
from tidemill.plans import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_every_other_query_has_its_own_test():
    """What SQL does not say is held against other computations in test_paths.py and test_rules.py."""
    assert set(queries.QUERIES) - set(queries.SQL) == {"hilbert", "longest_sequences", "monte_carlo", "portfolio_weights", "factor_exposures", "attention_scores", "backtest_runs"}
