"""Every query of the catalogue against its DuckDB SQL."""

import pytest
from conftest import plain_rows

from wavelake.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    rows = got.collect()
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert len(rows) and sorted(got.columns) == sorted(names)
    assert plain_rows(got.columns, rows) == plain_rows(names, want.fetchall())


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 12


def test_import_needs_no_session():
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
