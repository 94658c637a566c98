"""Every registered query against its SQL on the smallest data folder."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_check  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert contract.queries()[name](spark, FOLDER).count() > 0
    else:
        assert oracle_check.compare(spark, con, FOLDER, name, sql) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
