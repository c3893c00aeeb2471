"""Every registered query of the network against its DuckDB twin at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from thalweg.plans import network_queries, source_queries

SF = "/root/testdata/sf0.001"
SQL = network_queries.oracle_sql() | source_queries.oracle_sql()
QUERIES = network_queries.queries() | source_queries.queries()
SOME = ["outlet_area", "decode_d8", "ordering_dfs", "ordering_bfs", "conflicts", "dfs_interval", "upstream_area_lossy_push", "strahler_order_channels", "longest_upstream_path", "cycles", "geometry", "parallel_locality", "distance_to_outlet_exact", *source_queries.queries()]


def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(SOME) <= set(SQL)


@pytest.mark.parametrize("name", SOME)
def test_query_and_twin_agree(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF}/orders.parquet')")
    want = sorted_rows(con.execute(SQL[name]).df())
    got = sorted_rows(QUERIES[name](spark, SF).toPandas())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    assert len(got)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """A copy without the folders of these operators and the pipeline imports and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "thalweg", tmp_path / "thalweg", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'outlet_area' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()); assert e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True, timeout=120)
