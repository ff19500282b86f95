"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from conftest import TESTDATA

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402
from watchglass.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(TESTDATA)


REGISTERED = sorted(catalogue.all_queries())  # the optional part has tests of its own


@pytest.mark.parametrize("name", REGISTERED)
def test_query(spark, con, name):
    assert check_queries.compare(spark, con, TESTDATA, name) in ("", "both are empty")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"rule_id", "rule_title", "hits"}


def test_every_query_has_sql():
    assert set(REGISTERED) <= set(entry.oracle_sql()) and set(REGISTERED) <= set(entry.queries())
