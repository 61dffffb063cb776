"""The driver's view: every query without an llm prefix has an oracle, and agrees with it on a small scale."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_entry_points():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len([n for n in names if not n.startswith("op")]) > 90


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
def test_queries_agree_with_sql(spark):
    import duckdb

    from plumbline.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("size_where", "completeness", "stddev", "mutual_information_nulls", "histogram_topn", "analysis_batch", "check_where", "verification_suite", "anomaly_absolute"):
        got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None))), name
