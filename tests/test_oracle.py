"""Every registered query next to its SQL, on the smallest test tables."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle_check import compare

from trigwatch.plans import load_all

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
