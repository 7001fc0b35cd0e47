"""Every registered query against its DuckDB oracle on the smallest tables.

The driver runs the same comparison at sf0.01; this keeps it in the test
suite (sf0.001) so a change that breaks a query fails here first.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, key):
    df = entry.queries()[key](spark, SF)
    assert df.count() > 0 and len(df.columns) > 0


def test_entry_smoke(spark):
    assert entry.entry(spark).count() > 0


def test_landed_table_of_a_failed_write_is_built_anew(spark, tmp_path):
    """Part files without the mark of an ended write are no table; a whole one is not built again."""
    from retenza.plans.registry import landed

    (tmp_path / "input").write_text("x")
    whole = landed(spark, str(tmp_path), "whole", lambda: spark.range(5))
    half = os.path.dirname(os.path.dirname(whole.inputFiles()[0])) + "/half"
    spark.range(2).write.parquet(half)
    assert landed(spark, str(tmp_path), "half", lambda: spark.range(5)).count() == 5
    assert landed(spark, str(tmp_path), "half", lambda: spark.range(9)).count() == 5
