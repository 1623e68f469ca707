"""Every core query against its SQL: on the small tables, on dirtied ones (null rows, repeats, clashing extra columns) and on empty ones."""

from __future__ import annotations

import pytest

from tests.conftest import CLASHING, SF
from tests.oracle import compare, connect
from tidemark.plans import catalogue

@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_small(spark, name):
    if name in catalogue.ORACLES:
        assert compare(spark, connect(SF), catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


# Queries whose SQL differs on repeated rows of keys that are unique in the tables, or on null keys; they must only not fail.
LOOSE = {"p3_found", "p3_kept_per_batch", "p3_new_batches", "seed_exists", "upsert_episodes"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_dirty(spark, dirty, name):
    if name in catalogue.ORACLES and name not in LOOSE:
        assert compare(spark, connect(dirty, tuple(CLASHING)), catalogue.QUERIES[name], catalogue.ORACLES[name], dirty) is None
    else:
        assert catalogue.QUERIES[name](spark, dirty).count() >= 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty(spark, empty, name):
    assert catalogue.QUERIES[name](spark, empty).count() == 0


def test_comparison_sees_differences(spark):
    q, sql = catalogue.QUERIES["episodes_by_source"], catalogue.ORACLES["episodes_by_source"]
    con = connect(SF)
    assert compare(spark, con, q, sql.replace("count(*)", "count(*) + 1"), SF) and compare(spark, con, q, sql.replace("AS episodes", "AS other"), SF)
