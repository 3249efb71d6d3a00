"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from specframe.plans import load_queries  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert set(load_queries()[0]) == set(load_queries()[1])


@pytest.mark.parametrize("name", sorted(load_queries()[0]))
def test_query(spark, duck, name):
    ok, note, _ = check.compare(spark, duck, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
