"""Every registered query against its SQL at the smallest scale; without SQL it must at least give rows.

The queries of the corpus subpackage have their own tests.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tallyframe.plans import catalog

FOLDER = os.environ.get("LEDGER_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# Right results without rows at this scale: nothing is due, refused or late there.
EMPTY = set()


def test_every_comparison_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["space_id", "month", "value"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(frame, connect(FOLDER), ORACLES[name]) == ("no rows" if name in EMPTY else None)
    else:
        assert frame.count() > 0
