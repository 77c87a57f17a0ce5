"""Every core query against its SQL, or at least its schema."""

from __future__ import annotations

import pytest

from tests.oracle import compare
from textmill.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)
