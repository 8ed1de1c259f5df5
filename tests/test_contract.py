"""Every registered query against its SQL twin on the smallest tables.

Learners and file-heavy queries are left to ``python -m tests.oracle``, which runs all of them.
"""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, connect

HEAVY = {
    "scan_report_files", "week_cache_write", "week_cache_read", "build_features", "assemble", "corr_matrix",
}


@pytest.fixture(scope="session")
def con():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 179


def test_flagship_columns(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 85
    assert df.count() == 4 * 25 * df.select("week_start").distinct().count()


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - HEAVY))
def test_oracle(spark, con, name):
    make, sql = entry.queries()[name], entry.oracle_sql()[name]
    ok, note = compare(spark, SMALL, make, sql, con)
    assert ok or note.endswith("EMPTY"), note
