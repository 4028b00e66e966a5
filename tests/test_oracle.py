"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    text, _, ok = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "ok", "errors", "warns", "infos", "error_codes"]
    assert df.count() == 50


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
