"""Every registered query against its SQL text on the smallest tables."""

import pytest

from spendlake.plans.catalog import ORACLES, QUERIES, callables
from tests.conftest import SMALL
from tests.oracle import compare, connect

PLANS = callables()
#: Every user of the smallest tables has a receipt.
EMPTY = {"ins10_no_data"}
#: Queries that find nothing in the smallest tables run on the next larger ones.
LARGER = {"ano5_busy_days", "ano7_off_hours", "fil12_pending_by_approver", "fil12_pending_by_role", "fil2_approval_queue"}
NEXT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def next_con():
    return connect(NEXT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, next_con, name):
    folder, tables = (NEXT, next_con) if name in LARGER else (SMALL, con)
    problem = compare(PLANS[name](spark, folder), tables, ORACLES[name])
    assert problem == ("no rows on either side" if name in EMPTY else None)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = PLANS[name](spark, SMALL)
    assert rows.columns
    assert rows.count() > 0
