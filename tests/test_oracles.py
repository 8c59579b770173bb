"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_runner import compare, connect

from wattlake.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    table = QUERIES[name](spark, sf_dir).toArrow()
    if name in ORACLES:
        assert compare(table, con, ORACLES[name]) == []
    else:
        assert table.num_rows > 0
