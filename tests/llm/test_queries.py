"""Every query of the subpackage on small, dirtied and empty tables; against its SQL where it has one."""

from __future__ import annotations

import pytest

from tests.conftest import CLASHING, SF
from tests.oracle import compare, connect
from tidemark.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_small(spark, name):
    if name in catalogue.ORACLES:
        assert compare(spark, connect(SF), catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_dirty(spark, dirty, name):
    if name in catalogue.ORACLES:
        assert compare(spark, connect(dirty, tuple(CLASHING)), catalogue.QUERIES[name], catalogue.ORACLES[name], dirty) is None
    else:
        assert catalogue.QUERIES[name](spark, dirty).count() >= 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty(spark, empty, name):
    assert catalogue.QUERIES[name](spark, empty).count() == 0
